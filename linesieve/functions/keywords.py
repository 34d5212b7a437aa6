"""Plain words that every match of a pattern contains.

A search for a few fixed words costs far less than a case-insensitive
alternation, and most lines hold none of them; so a scan asks for the words
first. The words come from the standard library's own reading of the pattern,
once, when a catalog is turned into an expression.
"""

from functools import cache
from re import _constants as sre
from re import _parser as parser

from linesieve.functions.text import any_of, matches, q

SHORTEST = 2


def _score(words):
    """Prefer sets whose shortest word is long, then small sets."""
    return (min(map(len, words)), -len(words))


def _fit(candidates, shortest):
    return [c for c in candidates if c and min(map(len, c)) >= shortest]


def _head(items):
    """Literal text a sequence starts with."""
    text = ""
    for op, arg in items:
        if op is not sre.LITERAL or arg >= 128:
            break
        text += chr(arg).lower()
    return text


def _required(items, shortest):
    """A set of words one of which is in every match of the sequence, or None."""
    return max(_fit(_word_sets(items, shortest), shortest), key=_score, default=None)


def _word_sets(items, shortest):
    """Sets of words; every match of the sequence holds a word of each."""
    candidates, run = [], ""
    for op, arg in items:
        if op is sre.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            candidates.append(frozenset([run]))
            if op is sre.BRANCH:  # the parser moves a shared start in front of a branch
                candidates.append(frozenset(run + _head(part) for part in arg[1]))
            run = ""
        if op is sre.SUBPATTERN:
            candidates.append(_required(arg[3], shortest))
        elif op is sre.BRANCH:
            parts = [_required(part, shortest) for part in arg[1]]
            if all(parts):
                candidates.append(frozenset().union(*parts))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            candidates.append(_required(arg[2], shortest))
    if run:
        candidates.append(frozenset([run]))
    return candidates


def _parse(pattern):
    return parser.parse(pattern.replace(r"\z", r"\Z"))


@cache
def keywords(pattern: str):
    """Lower-case words, one of which every match contains; None if unknown."""
    return _required(_parse(pattern), SHORTEST)


@cache
def needs(pattern: str):
    """The most telling word sets of a pattern; a match holds one word of each.

    Where a pattern asks for a call and, anywhere behind it, a word, the second
    set spares the matcher from trying every call of a long line in vain. Single
    characters count among others, but not alone.
    """
    sets = dict.fromkeys(s for s in _fit(_word_sets(_parse(pattern), 1), 1) if len(s) > 1 or len(min(s)) > 1)
    return sorted(sets, key=_score, reverse=True)[:3]


def _holds_word(words) -> str:
    # a word that contains another one adds nothing
    kept = sorted(w for w in words if not any(o != w and o in w for o in words))
    return any_of(f"contains(low, {q(w)})" for w in kept)


def _guarded(text, pattern) -> str:
    return "(" + " AND ".join([*map(_holds_word, needs(pattern)), matches(text, pattern)]) + ")"


def _bound(text, condition) -> str:
    """The lower-cased text, computed once as ``low`` of a one-element array."""
    return f"exists(array(lower({text})), low -> {condition})"


def worded(text, patterns) -> str | None:
    """Condition: the text holds a word without which no pattern can match."""
    sets = [keywords(p) for p in patterns]
    if not sets or None in sets:
        return None
    return _bound(text, _holds_word(set().union(*sets)))


def with_low(text, entries) -> str:
    """Array ``entries`` (SQL text, whose parts may come from ``low_guarded``) over a text that is lower-cased once for all of them."""
    return f"flatten(transform(array(lower({text})), low -> {entries}))"


def low_guarded(text, pattern) -> str:
    """``guarded`` inside of ``with_low``."""
    return _guarded(text, pattern) if needs(pattern) else matches(text, pattern)


def guarded(text, pattern) -> str:
    """``matches`` with the pattern's words in front of it."""
    return _bound(text, _guarded(text, pattern)) if needs(pattern) else matches(text, pattern)


def may_match(text, patterns, near=None) -> str:
    """Some pattern matches: words of all, unless the text is known to be ``near``, then words and matcher of each."""
    patterns = list(dict.fromkeys(patterns))
    each = any_of(_guarded(text, p) for p in patterns)
    sets = [keywords(p) for p in patterns]
    if near or not sets or None in sets:
        return _bound(text, each)
    return _bound(text, f"{_holds_word(set().union(*sets))} AND {each}")
