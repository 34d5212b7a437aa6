"""Condition trees over a line and its neighbours, compiled to SQL expressions.

A tree is evaluated at one line of a file whose lines are an array column, so a
guard is only searched around lines whose own pattern already matched, and no
row has to leave its partition. Contexts above a line are looked up in strings
with one character per line, made once per file (``context_fields``).
"""

from dataclasses import dataclass

from linesieve.functions.keywords import guarded
from linesieve.functions.text import is_blank

NEAR_LINES = 10
BLANK_DISTANCE = 5


@dataclass(frozen=True)
class Condition:
    kind: str
    pattern: str | None = None
    children: tuple = ()

    def patterns(self):
        own = [self.pattern] if self.pattern else []
        return own + [p for c in self.children for p in c.patterns()]


def leaf(pattern):
    return Condition("leaf", pattern)


def all_of(*children):
    return Condition("all_of", children=children)


def any_of(*children):
    return Condition("any_of", children=children)


def none_near(child):
    child = leaf(child) if isinstance(child, str) else child
    return Condition("none_near", children=(child,))


def inside(pattern):
    return Condition("inside", pattern)


def not_inside(pattern):
    return Condition("not_inside", pattern)


def entry_patterns(cond: Condition):
    """Leaf patterns of which at least one matches wherever the tree is true.

    None if the tree can hold on a line without a match of its own.
    """
    if cond.kind == "leaf":
        return [cond.pattern]
    if cond.kind == "any_of":
        parts = [entry_patterns(c) for c in cond.children]
        return None if None in parts else [p for part in parts for p in part]
    if cond.kind == "all_of":
        parts = [p for p in map(entry_patterns, cond.children) if p is not None]
        return min(parts, key=len) if parts else None
    return None


def matches_between(lines, first, last, pattern) -> str:
    span = f"slice({lines}, {first}, greatest({last} - {first} + 1, 0))"
    return f"exists({span}, w -> {guarded('w', pattern)})"


def guard_patterns(cond: Condition):
    """Patterns that are looked for on the lines around a line."""
    own = [cond.children[0].pattern] if cond.kind == "none_near" and cond.children[0].kind == "leaf" else []
    return own + [p for c in cond.children for p in guard_patterns(c)]


def context_patterns(cond: Condition):
    """Patterns that are looked for above a line."""
    own = [cond.pattern] if cond.kind in ("inside", "not_inside") else []
    return own + [p for c in cond.children for p in context_patterns(c)]


def _marked(lines, test) -> str:
    return f"array_join(transform({lines}, w -> IF({test}, '1', '.')), '')"


def context_fields(lines, patterns: dict, near=None) -> str:
    """Struct of strings with a 1 for every line that is blank (``blanks``) or matches a pattern.

    ``patterns`` maps a pattern to (field name, condition under which it can be asked for). Of ``near`` lines, those that hold a
    word of some pattern, the numbers of the matching ones stand in place of the string.
    """
    def marked(p):
        if near is None:
            return _marked(lines, guarded('w', p)), "''"
        return f"filter({near}, c -> {guarded(f'get({lines}, c - 1)', p)})", "CAST(array() AS array<int>)"

    fields = [f"'blanks', {_marked(lines, is_blank('w'))}"]
    fields += [f"'{name}', IF({when}, {marked(p)[0]}, {marked(p)[1]})" for p, (name, when) in patterns.items()]
    return f"named_struct({', '.join(fields)})"


def _last_before(marks, line_no) -> str:
    """Number of the last marked line above a line, 0 without one."""
    return f"length(rtrim('.', left({marks}, {line_no} - 1)))"


def inside_at(context, line_no, pattern, listed=False) -> str:
    """An earlier line matches, back to a blank line more than five above. The context's lines are a string or ``listed``."""
    hit, blank = _last_before(context(pattern), line_no), _last_before(context(None), f"({line_no} - {BLANK_DISTANCE})")
    if listed:
        hit = f"coalesce(array_max(filter({context(pattern)}, c -> c < {line_no})), 0)"
    return f"({hit} > 0 AND {hit} >= {blank})"


def none_near_at(lines, line_no, child: Condition, context=None, guards=None) -> str:
    """``guards`` numbers the lines that hold a word of some guard; others are not looked at, if given."""
    if guards and child.kind == "leaf":
        return (f"(NOT exists({guards}, g -> g BETWEEN {line_no} - {NEAR_LINES} AND {line_no} + {NEAR_LINES} "
                f"AND {guarded(f'get({lines}, g - 1)', child.pattern)}))")
    first = f"greatest({line_no} - {NEAR_LINES}, 1)"
    last = f"least({line_no} + {NEAR_LINES}, size({lines}))"
    if child.kind == "leaf":
        return f"(NOT {matches_between(lines, first, last, child.pattern)})"
    here = holds(child, f"get({lines}, n - 1)", lines, "n", context, guards)
    return f"(NOT exists(sequence({first}, {last}), n -> {here}))"


def holds(cond: Condition, text, lines, line_no, context=None, guards=None, leaf_test=guarded) -> str:
    """SQL condition; ``context`` gives the field of ``context_fields`` for a pattern, or for the blanks (None).

    ``guards`` numbers the lines near a guard; then the context lists its lines, too. ``leaf_test`` is ``low_guarded`` where the text stands lower-cased in ``low`` (``keywords.with_low``).
    """
    if cond.kind == "leaf":
        return leaf_test(text, cond.pattern)
    if cond.kind in ("all_of", "any_of"):
        word = " AND " if cond.kind == "all_of" else " OR "
        return "(" + word.join(holds(c, text, lines, line_no, context, guards, leaf_test) for c in cond.children) + ")"
    if cond.kind == "none_near":
        return none_near_at(lines, line_no, cond.children[0], context, guards)
    found = inside_at(context, line_no, cond.pattern, listed=guards is not None)
    return found if cond.kind == "inside" else f"(NOT {found})"
