"""Line-pattern rules: scan, suppressions, grades."""

import heapq

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linesieve.catalog import files as fixed
from linesieve.catalog.rules import RULES
from linesieve.catalog.texts import ADVICE, ADVICE_ELSE
from linesieve.functions.keywords import low_guarded, may_match, with_low
from linesieve.functions.names import Names
from linesieve.functions.text import (
    contains_any, fingerprint, group, is_line_comment, left_trimmed, matches, one_of, opens_block, q, settle,
    starts_with_any, trimmed)
from linesieve.operators.lines import (
    FILE_COLUMNS, block_marks, by_language, context_after, context_before, in_block, numbered)
from linesieve.operators.near import words_by_language

FREE_CALL = next(r[6] for r in RULES if r[0] == "C-UAF-001")
FREE_LANGS = next(r[4] for r in RULES if r[0] == "C-UAF-001").split()
DOUBLE_FREE = "C-MEM-001"
UNTESTED_ALLOC = "C-MEM-002"
REUSE_LANGS = next(r[4] for r in RULES if r[0] == DOUBLE_FREE).split()
FREED_POINTER = r"free\s*\(\s*(\w+)\s*\)"
ASSIGNED_POINTER = r"^\s*(?:\w+\s+)?\**\s*(\w+)\s*=[^=]"
RULE_SCHEMA = "rule_id string, rule_name string, category string, severity string, cwe string, remediation string"


def line_rules():
    return [(langs, (rule_id, pattern)) for rule_id, _, _, _, langs, _, pattern in RULES if pattern]


def rule_table(spark: SparkSession) -> DataFrame:
    """One row per rule id; the size is that of the catalog."""
    rows = {r[0]: (r[0], r[1], r[2], r[3], r[5], ADVICE.get(r[2], ADVICE_ELSE)) for r in reversed(RULES)}
    return spark.createDataFrame(list(rows.values()), RULE_SCHEMA)


def scope_ends() -> str:
    """array<struct<line_no, depth>>: lines of a C file that may end a scope."""
    body = trimmed("s.text")
    ends = f"({body} = '}}' OR {starts_with_any(body, fixed.SCOPE_END_STARTS)})"
    rows = (f"transform({numbered('lines', ends)}, s -> named_struct('line_no', s.line_no, "
            f"'depth', length(s.text) - length({body})))")
    none = "CAST(array() AS array<struct<line_no:int,depth:int>>)"
    return f"IF({one_of('ext', FREE_LANGS)} AND exists(lines, t -> contains(t, 'free')), {rows}, {none})"


def free_scan() -> str:
    """What ``sweep`` asks of a C file with a free call: the calls (number among the candidates, line, pointer, depth), the scope
    ends, and the lines from the first call on. Null for other files."""
    calls = (f"filter(transform(candidates, (c, i) -> IF({matches('c.text', FREE_CALL)}, named_struct('at', i, 'line_no', c.line_no, "
             f"'pointer', {group('c.text', FREE_CALL, 1)}, 'depth', length(c.text) - length({left_trimmed('c.text')})), NULL)), "
             "c -> c IS NOT NULL)")
    scan = ("named_struct('calls', calls, 'ends', scope_ends, 'first', calls[0].line_no, "
            "'lines', slice(lines, calls[0].line_no, size(lines)))")
    return (f"IF({one_of('ext', FREE_LANGS)}, get(transform(filter(array({calls}), calls -> size(calls) > 0), calls -> {scan}), 0), NULL)")


def sweep(calls, ends, first, lines):
    """Numbers of the free calls whose pointer is named again before its scope ends.

    One pass down the lines with the calls that are still open. A scope end closes the calls no
    less deep than itself, the deepest first. A line that names the pointer of open calls outside a
    comment decides them all: nullified or used. Every call is opened and closed once, and names
    are looked up by the parts of a line that are as long as some open pointer.
    """
    starts, closing = {}, {e["line_no"]: e["depth"] for e in ends}
    for call in calls:
        starts.setdefault(call["line_no"], []).append(call)
    open_calls, names, depths, used = {}, Names(), [], []
    for line_no, text in enumerate(lines, first):
        if open_calls and line_no in closing:
            while depths and -depths[0][0] >= closing[line_no]:
                _, at, pointer = heapq.heappop(depths)
                if at in open_calls.get(pointer, ()):
                    open_calls[pointer].discard(at)
                    if not open_calls[pointer]:
                        del open_calls[pointer]
                        names.remove(pointer)
        if open_calls:
            body = text.strip(" \t\r\n\x0b\x0c")
            null = any(mark in body for mark in fixed.NULLIFY_MARKS)
            if null or not body.startswith(("//", "/*")):
                for pointer in names.within(text):
                    decided = open_calls.pop(pointer)
                    names.remove(pointer)
                    if not null:
                        used.extend(decided)
        for call in starts.get(line_no, ()):
            names.add(call["pointer"])
            open_calls.setdefault(call["pointer"], set()).add(call["at"])
            heapq.heappush(depths, (-call["depth"], call["at"], call["pointer"]))
    return used


def freed_again(events):
    """Numbers of the free calls whose pointer's last event in the file was a free call, too."""
    last, out = {}, []
    for i, event in enumerate(events):
        if event["frees"] and last.get(event["pointer"]):
            out.append(i)
        last[event["pointer"]] = event["frees"]
    return out


def judged(facts: DataFrame) -> DataFrame:
    """Facts with ``used`` (a flag for each candidate) and ``doubled`` (numbers of pointer events) in place of ``free_scan``.

    Only C files with a free call are looked at; other rows pass as they are.
    """
    own = facts.drop("free_scan")
    schema = T.StructType([*own.schema.fields, *T.StructType.fromDDL("used array<boolean>, doubled array<int>").fields])

    def judge(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        types = to_arrow_schema(schema)
        for batch in batches:
            scans, events = batch.column("free_scan"), batch.column("pointer_events")
            used, doubled = [None] * batch.num_rows, [None] * batch.num_rows
            for i in pc.indices_nonzero(scans.is_valid()).to_pylist():
                scan = scans[i].as_py()
                found = set(sweep(scan["calls"], scan["ends"], scan["first"], scan["lines"]))
                used[i] = [at in found for at in range(len(batch.column("candidates")[i]))]
            for i in pc.indices_nonzero(events.is_valid()).to_pylist():
                own = events[i].values
                doubled[i] = freed_again([{"pointer": p, "frees": f} for p, f in zip(
                    own.field("pointer").to_pylist(), own.field("frees").to_pylist())])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name).cast(f.type) for f in list(types)[:-2]], pa.array(used, types.field("used").type),
                 pa.array(doubled, types.field("doubled").type)], schema=types)

    return facts.mapInArrow(judge, schema)


def _null_tested(lines, line_no, rules) -> str:
    """One of the next three lines tests for null or starts a condition. Only asked in the languages of the rule that it silences."""
    langs = sorted({lang for names, (rule_id, _) in rules if rule_id == UNTESTED_ALLOC for lang in names.split()})
    if not langs:
        return "false"
    tested = contains_any("low", fixed.NULL_TEST_MARKS)
    return (f"({one_of('ext', langs)} AND exists({context_after(lines, line_no)}, "
            f"t -> exists(array(lower(t)), low -> {tested})))")


def is_defensive(text, rule_id) -> str:
    return f"({one_of(rule_id, fixed.DEFENSIVE_RULES)} AND {contains_any(f'lower({text})', fixed.DEFENSIVE_WORDS)})"


def rule_words(rules=None) -> dict:
    return words_by_language([(langs, [p]) for langs, (_, p) in rules or line_rules()])


def candidates(rules=None, near=None) -> str:
    """array<struct> of the code lines of a file that meet some rule of its language.

    The lines are tested against the words and one alternation of the language's
    rules, comments are dropped, and what the rules need of the neighbourhood is
    taken along. Reads ``lines`` and the columns of ``line_marks``.
    """
    hit = by_language(rules or line_rules(), lambda es: may_match("s.text", [p for _, p in es], near), "false")
    wanted = (f"NOT {is_line_comment('s.text')} AND NOT {opens_block('s.text')} AND {hit} "
              f"AND NOT {in_block('marks', 's.line_no')}")
    return (f"transform({numbered('lines', wanted, near)}, s -> named_struct('line_no', s.line_no, 'text', s.text, "
            f"'context_before', {context_before('lines', 's.line_no')}, "
            f"'context_after', {context_after('lines', 's.line_no')}, "
            f"'null_tested', {_null_tested('lines', 's.line_no', rules or line_rules())}))")


def pointer_events() -> str:
    """array<struct> of free calls and assignments of a C file with a free call."""
    freed, target = group("s.text", FREED_POINTER, 1), group("s.text", ASSIGNED_POINTER, 1)
    wanted = "contains(s.text, 'free') OR contains(s.text, '=')"
    rows = (f"transform({numbered('lines', wanted)}, s -> named_struct('line_no', s.line_no, 'text', s.text, "
            f"'pointer', coalesce(nullif({freed}, ''), nullif({target}, '')), 'frees', {freed} <> '', "
            f"'context_before', {context_before('lines', 's.line_no')}, "
            f"'context_after', {context_after('lines', 's.line_no')}))")
    return (f"IF({one_of('ext', REUSE_LANGS)} AND exists(lines, t -> contains(t, 'free')), "
            f"filter({rows}, e -> e.pointer IS NOT NULL AND NOT {is_line_comment('e.text')}), NULL)")


def line_marks() -> dict:
    """What ``candidates`` looks up for each line, computed once per file."""
    return {"marks": block_marks("lines"), "scope_ends": scope_ends()}


def pattern_facts(files: DataFrame, rules=None, more: dict | None = None) -> DataFrame:
    """``candidates`` and ``pointer_events`` of the files that have any, judged: one narrow pass.

    ``more`` are columns (name to expression) that another engine needs of the same files.
    """
    marked = settle(files, [*FILE_COLUMNS, "lines"], line_marks())
    columns = {"candidates": candidates(rules), "pointer_events": pointer_events(), **(more or {})}
    facts = settle(marked, [*FILE_COLUMNS, "lines", "scope_ends"], columns)
    return judged(with_free_scan(facts.filter("size(candidates) > 0 OR size(pointer_events) > 0"), columns))


def with_free_scan(facts: DataFrame, keep) -> DataFrame:
    return facts.selectExpr(*FILE_COLUMNS, *keep, f"{free_scan()} AS free_scan")


def _fields(row, used, again) -> str:
    return (f"named_struct('line_no', {row}.line_no, 'text', {row}.text, 'context_before', {row}.context_before, "
            f"'context_after', {row}.context_after, 'null_tested', {'false' if again == 'true' else row + '.null_tested'}, "
            f"'used_after_free', {used}, 'freed_again', {again})")


CODE_LINES = f"transform(candidates, (c, i) -> {_fields('c', 'coalesce(get(used, i), false)', 'false')})"
SECOND_FREES = f"transform(coalesce(doubled, array()), i -> {_fields('pointer_events[i]', 'false', 'true')})"


def raw_matches(facts: DataFrame, rules=None) -> DataFrame:
    """Line x rule of its language -> first matched text, before suppressions.

    Two forms of one rule id on a line count once, the first form winning.
    """
    return matched_lines(facts.selectExpr(*FILE_COLUMNS, f"inline({CODE_LINES})"), rules).drop("freed_again")


def matched_lines(rows: DataFrame, rules=None) -> DataFrame:
    """The rules that each line meets. A second free call meets its one rule only."""
    rules = rules or line_rules()

    def hits(entries):
        merged = {}
        for rule_id, pattern in entries:
            merged.setdefault(rule_id, []).append(pattern)
        found = []
        for rule_id, patterns in merged.items():
            arms = " ".join(f"WHEN {low_guarded('text', p)} THEN named_struct('rule_id', {q(rule_id)}, "
                            f"'matched_text', {group('text', p)})" for p in patterns)
            found.append(f"CASE {arms} END")
        return with_low("text", f"filter(array({', '.join(found)}), h -> h IS NOT NULL)")

    none = "CAST(array() AS array<struct<rule_id:string,matched_text:string>>)"
    again = f"array(named_struct('rule_id', {q(DOUBLE_FREE)}, 'matched_text', {group('text', FREED_POINTER)}))"
    return rows.selectExpr("*", f"inline(IF(freed_again, {again}, {by_language(rules, hits, none)}))")


def use_after_free(matched: DataFrame) -> DataFrame:
    return matched.filter("rule_id <> 'C-UAF-001' OR used_after_free")


def alloc_null_check(matched: DataFrame) -> DataFrame:
    return matched.filter(f"rule_id <> {q(UNTESTED_ALLOC)} OR NOT null_tested")


def defensive_code(matched: DataFrame) -> DataFrame:
    return matched.filter(f"NOT {is_defensive('text', 'rule_id')}")


def grade(matched: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule fields, fingerprint and path confidence. The rule table has the
    fixed size of the catalog, hence the broadcast."""
    return graded(matched.join(F.broadcast(rules), "rule_id"))


def graded(ruled: DataFrame) -> DataFrame:
    return ruled.selectExpr(
        "repo", "path", "ext", "line_no", "rule_id", "rule_name", "category", "severity", "cwe",
        "remediation", "text", "matched_text", "context_before", "context_after",
        f"{fingerprint('rule_id', 'path', 'line_no')} AS fingerprint",
        "IF(is_test, 'LOW', 'HIGH') AS confidence")


MATCH_COLUMNS = ["repo", "path", "ext", "is_test", "line_no", "text", "context_before", "context_after",
                 "rule_id", "matched_text"]


def pattern_scan(facts: DataFrame, rules=None) -> DataFrame:
    """Findings of the line rules, without any shuffle of lines."""
    return grade(kept_matches(raw_matches(facts, rules)), rule_table(facts.sparkSession))


def kept_matches(matched: DataFrame) -> DataFrame:
    return defensive_code(alloc_null_check(use_after_free(matched))).select(*MATCH_COLUMNS)


def double_free(facts: DataFrame) -> DataFrame:
    """The same pointer freed twice in a file with no assignment in between."""
    events = facts.selectExpr(*FILE_COLUMNS, "inline(transform(coalesce(doubled, array()), i -> pointer_events[i]))")
    return events.selectExpr("*", f"{q(DOUBLE_FREE)} AS rule_id", f"{group('text', FREED_POINTER)} AS matched_text")


def all_findings(facts: DataFrame, lines: str = f"concat({CODE_LINES}, {SECOND_FREES})") -> DataFrame:
    """Line rules and double frees, in one pass over the facts; see ``pattern_facts`` for the input."""
    rows = facts.selectExpr(*FILE_COLUMNS, f"inline({lines})")
    return grade(kept_matches(matched_lines(rows)), rule_table(facts.sparkSession))


def uncovered_findings(facts: DataFrame) -> DataFrame:
    """``all_findings`` without the lines that a composite rule reports as well (``held``, see ``composite.held_rules``).

    Both engines' lines of a file stand in one row. They are merged by line number, and a line behind
    a reported one of its number goes: a set difference inside the row, without a join.
    """
    rows = f"transform(concat({CODE_LINES}, {SECOND_FREES}), c -> named_struct('line_no', c.line_no, 'own', 1, 'line', c))"
    reported = "transform(filter(coalesce(held, array()), h -> size(h.rules) > 0), h -> named_struct('line_no', h.line_no, 'own', 0, 'line', NULL))"
    order = "(a, b) -> CASE WHEN a.line_no <> b.line_no THEN a.line_no - b.line_no ELSE a.own - b.own END"
    merged = settle(facts, FILE_COLUMNS, {"merged": f"array_sort(concat({rows}, {reported}), {order})"})

    def behind(k):  # a line stands at most twice among the rules' lines, once as a second free
        return f"coalesce(get(merged, i - {k}).own = 0 AND get(merged, i - {k}).line_no = m.line_no, false)"

    left = f"filter(transform(merged, (m, i) -> IF(m.own = 1 AND NOT {behind(1)} AND NOT {behind(2)}, m.line, NULL)), c -> c IS NOT NULL)"
    return all_findings(merged, left)
