"""Taint: untrusted sources joined to dangerous sinks of the same file.

The sources, sinks and sanitizer lines of a file are collected as small arrays
in one narrow pass. Inside the row an index of the variables tells which of them
a sink names; a sink and a variable are one interval of the sources in line
order, and become single pairs only where rows are asked for.
"""

from bisect import bisect_left

from pyspark.sql import DataFrame

from linesieve.catalog import flows
from linesieve.functions.keywords import low_guarded, may_match, with_low
from linesieve.functions.names import Names
from linesieve.functions.rows import added_in_rows
from linesieve.functions.text import (
    any_of, contains_any, ends_with_any, group, indent_width, matches, matches_any, q, settle,
    starts_with_any, trimmed)
from linesieve.operators.near import words_by_language
from linesieve.operators.lines import (
    FILE_COLUMNS, block_heads, by_language, class_heads, function_heads, in_test_scope, numbered, scopes)

SOURCE_TYPE = "array<struct<variable:string,source_type:string>>"
SINK_TYPE = "array<struct<sink_type:string,severity:string,cwe:string,rank:int>>"
HIGH_DISTANCE = 20


def is_false_source(lines, line_no, text) -> str:
    """Constants, parametrized test values and dictionary views are no input.

    A decorator up to three lines above counts as long as the lines between
    continue a statement.
    """
    def above(k):
        return trimmed(f"get({lines}, {line_no} - {1 + k})")

    def decorated(k):
        return f"coalesce({starts_with_any(above(k), flows.FIXTURE_DECORATORS)}, false)"

    def goes_on(k):
        return f"coalesce({above(k)} = '' OR {ends_with_any(above(k), [',', '(', chr(92)])}, false)"

    test_values = (f"({decorated(1)} OR ({goes_on(1)} AND ({decorated(2)} OR "
                   f"({goes_on(2)} AND {decorated(3)}))))")
    body = trimmed(text)
    return any_of([starts_with_any(body, flows.PARAM_DECORATORS), contains_any(body, flows.DICT_VIEWS),
                   matches_any(body, flows.LITERAL_SIDES), test_values])


def source_words(catalog) -> dict:
    return words_by_language([(langs, [pattern]) for _, langs, pattern in catalog])


def sink_words(catalog) -> dict:
    return words_by_language([(row[1], [row[4]]) for row in catalog])


def sanitizer_words() -> dict:
    return words_by_language([(langs, [pattern]) for langs, (_, pattern) in sanitizer_table()])


def find_sources(lines, catalog, near=None) -> str:
    """array<struct<variable, line_no, source_type, text>> of one file."""
    table = [(langs, (kind, pattern)) for kind, langs, pattern in catalog]
    hit = by_language(table, lambda es: may_match("s.text", [p for _, p in es], near), "false")
    wanted = f"{hit} AND NOT {is_false_source(lines, 's.line_no', 's.text')}"

    def captured(entries):
        found = [f"IF({group('s.text', p, 1)} <> '', named_struct('variable', {group('s.text', p, 1)}, "
                 f"'source_type', {q(kind)}), NULL)" for kind, p in entries]
        return f"filter(array({', '.join(found)}), v -> v IS NOT NULL)"

    found = by_language(table, captured, f"CAST(array() AS {SOURCE_TYPE})")
    return (f"flatten(transform({numbered(lines, wanted, near)}, s -> transform({found}, v -> named_struct("
            f"'variable', v.variable, 'line_no', s.line_no, 'source_type', v.source_type, 'text', s.text))))")


def is_safe_call(text) -> str:
    """Calls with an argument list and no shell, or over a dict view."""
    low = f"lower({text})"
    return (f"(({contains_any(low, flows.SHELL_OFF)} AND {contains_any(low, flows.LIST_CALLS)}) "
            f"OR {contains_any(low, flows.DICT_VIEWS)})")


def find_sinks(lines, catalog, near=None) -> str:
    """array<struct<line_no, text, sink_type, severity, cwe, rank>> of one file.

    ``catalog`` rows are (sink type, languages, severity, cwe, pattern); rank is
    the catalog position.
    """
    table = [(langs, (rank, kind, severity, cwe, pattern))
             for rank, (kind, langs, severity, cwe, pattern) in enumerate(catalog)]
    wanted = by_language(table, lambda es: may_match("s.text", [e[4] for e in es], near), "false")

    def met(entries):
        found = []
        for rank, kind, severity, cwe, p in entries:
            test = low_guarded("s.text", p)
            if kind == "command_execution":
                test = f"{test} AND NOT {is_safe_call('s.text')}"
            found.append(f"IF({test}, named_struct('sink_type', {q(kind)}, 'severity', {q(severity)}, "
                         f"'cwe', {q(cwe)}, 'rank', {rank}), NULL)")
        return with_low("s.text", f"filter(array({', '.join(found)}), k -> k IS NOT NULL)")

    found = by_language(table, met, f"CAST(array() AS {SINK_TYPE})")
    return (f"flatten(transform({numbered(lines, wanted, near)}, s -> transform({found}, k -> named_struct("
            f"'line_no', s.line_no, 'text', s.text, 'sink_type', k.sink_type, 'severity', k.severity, "
            f"'cwe', k.cwe, 'rank', k.rank))))")


TAINT_SINKS = [(kind, langs, severity, "", pattern) for kind, langs, severity, pattern in flows.TAINT_SINKS]


def sanitizer_table():
    """(languages, (sink kinds protected, pattern)) for the kinds taint knows.

    A category protects a sink kind whose name contains one of its words.
    """
    table = []
    for _, words, langs, pattern in flows.SANITIZERS:
        kinds = [s[0] for s in flows.TAINT_SINKS if any(w in s[0] for w in words.split())]
        if kinds:
            table.append((langs, (tuple(kinds), pattern)))
    return table


def find_sanitizers(lines, near=None) -> str:
    """array<struct<line_no, text, kinds>>: what sink kinds a line protects."""
    table = sanitizer_table()
    wanted = by_language(table, lambda es: may_match("s.text", [p for _, p in es], near), "false")

    def kinds(entries):
        parts = [f"IF({matches('s.text', p)}, array({', '.join(map(q, ks))}), CAST(array() AS array<string>))"
                 for ks, p in entries]
        return f"concat({', '.join(parts)})"

    found = by_language(table, kinds, "CAST(array() AS array<string>)")
    return (f"transform({numbered(lines, wanted, near)}, s -> named_struct('line_no', s.line_no, "
            f"'text', s.text, 'kinds', {found}))")


def taint_sources(files: DataFrame) -> DataFrame:
    return files.selectExpr("repo", "path", "ext", f"inline({find_sources('lines', flows.TAINT_SOURCES)})")


def taint_sinks(files: DataFrame) -> DataFrame:
    return files.selectExpr("repo", "path", "ext", f"inline({find_sinks('lines', TAINT_SINKS)})").drop("cwe", "rank")


def sink_scopes(files: DataFrame) -> DataFrame:
    """Scope of every line with a taint sink."""
    facts = settle(files, ["repo", "path"], {
        "sinks": find_sinks("lines", TAINT_SINKS), "functions": function_heads("lines"),
        "classes": class_heads("lines"), "blocks": block_heads("lines")})
    at = "array_distinct(transform(sinks, k -> named_struct('line_no', k.line_no, 'text', k.text)))"
    targets = facts.selectExpr("repo", "path", "functions", "classes", "blocks", f"inline({at})")
    return scopes(targets.selectExpr("*", f"{indent_width('text')} AS indent"))


def words() -> dict:
    """Catalogs of ``near.with_near`` for a scan."""
    return {"taint_source": source_words(flows.TAINT_SOURCES), "taint_sink": sink_words(TAINT_SINKS), "taint_sanitizer": sanitizer_words()}


def seeds(near=False) -> dict:
    return {"taint_sources": find_sources("lines", flows.TAINT_SOURCES, near and "near.taint_source")}


def reached(near=False) -> dict:
    """What a file with taint sources is searched for besides."""
    def where_seeded(expr):
        return f"IF(size(taint_sources) > 0, {expr}, NULL)"
    return {"taint_sinks": where_seeded(find_sinks("lines", TAINT_SINKS, near and "near.taint_sink")),
            "taint_sanitizers": where_seeded(find_sanitizers("lines", near and "near.taint_sanitizer")),
            "functions": where_seeded(function_heads("lines"))}


def taint_facts(files: DataFrame) -> DataFrame:
    """Sources, sinks, sanitizer lines and function headers per file."""
    seeded = settle(files, [*FILE_COLUMNS, "lines"], seeds())
    return settle(seeded, [*FILE_COLUMNS, "taint_sources"], reached())


REACH_FIELDS = "by_variable array<int>, reach array<struct<sink: int, start: int, n: int>>"


def reached_sinks(sources, sinks):
    """Sources of a file in order of variable and line (their numbers), and what reaches a sink, as intervals of that order.

    A sink is reached by the sources of a variable that it names on the lines above, which stand
    first among the variable's. So a sink and a variable make one interval, however many sources.
    """
    order = sorted(range(len(sources)), key=lambda i: (sources[i]["variable"], sources[i]["line_no"]))
    groups = {}
    for place, i in enumerate(order):
        groups.setdefault(sources[i]["variable"], (place, []))[1].append(sources[i]["line_no"])
    names, reach = Names(groups), []
    for k, sink in enumerate(sinks):
        for name in names.within(sink["text"]):
            start, lines = groups[name]
            if n := bisect_left(lines, sink["line_no"]):
                reach.append({"sink": k, "start": start, "n": n})
    return order, reach


def with_reach(facts: DataFrame) -> DataFrame:
    """Files with taint sources, with ``by_variable`` and ``reach``. Rows stay where they are."""
    rows = facts.filter("size(taint_sources) > 0").select(
        *FILE_COLUMNS, "taint_sources", "taint_sinks", "taint_sanitizers", "functions")
    return added_in_rows(rows, REACH_FIELDS, ["taint_sources", "taint_sinks"], reached_sinks)


def tainted_intervals(facts: DataFrame) -> DataFrame:
    """A row for each sink and variable that reaches it, with the variable's ``sources`` above the sink in line order."""
    row = ("named_struct('sink', taint_sinks[r.sink], "
           "'sources', transform(slice(by_variable, r.start + 1, r.n), i -> taint_sources[i]), "
           "'sanitizers', filter(taint_sanitizers, z -> z.line_no <= taint_sinks[r.sink].line_no "
           "AND array_contains(z.kinds, taint_sinks[r.sink].sink_type)), "
           f"'in_test_scope', {in_test_scope('functions', 'taint_sinks[r.sink].line_no', indent_width('taint_sinks[r.sink].text'))})")
    return with_reach(facts).selectExpr(*FILE_COLUMNS, f"inline(transform(reach, r -> {row}))")


def tainted_pairs(facts: DataFrame) -> DataFrame:
    """Source and sink of one file: sink later, naming the variable. The intervals, source by source."""
    first = "get(filter(sanitizers, z -> z.line_no > source.line_no), 0)"
    pairs = tainted_intervals(facts).selectExpr(*FILE_COLUMNS, "sink", "sanitizers", "in_test_scope", "explode(sources) AS source")
    return pairs.selectExpr(*FILE_COLUMNS, "source", "sink", f"{first} AS sanitizer", "in_test_scope")


def taint_grade(pairs: DataFrame) -> DataFrame:
    marked = pairs.selectExpr("*", "sanitizer IS NOT NULL AS is_sanitized", "is_test OR in_test_scope AS in_test")
    return marked.selectExpr(
        "*",
        "CASE WHEN in_test OR is_sanitized THEN 'LOW' "
        f"WHEN sink.line_no - source.line_no < {HIGH_DISTANCE} THEN 'HIGH' ELSE 'MEDIUM' END AS confidence",
        "CASE WHEN is_sanitized THEN 'LOW' WHEN in_test THEN 'INFO' ELSE sink.severity END AS severity")


def taint_findings(facts: DataFrame) -> DataFrame:
    return taint_grade(tainted_pairs(facts)).selectExpr(
        "repo", "path", "ext",
        "named_struct('line_no', source.line_no, 'text', source.text, 'source_type', source.source_type, "
        "'variable', source.variable) AS source",
        "named_struct('line_no', sink.line_no, 'text', sink.text, 'sink_type', sink.sink_type) AS sink",
        "concat(source.variable, ', set by ', source.source_type, ' in line ', source.line_no, ', is used by ', "
        "sink.sink_type, ' in line ', sink.line_no, IF(is_sanitized, ', cleaned between', '')) AS description",
        "severity", "confidence", "is_sanitized",
        f"concat('Sanitizer at line ', sanitizer.line_no, ': ', {trimmed('sanitizer.text')}) AS sanitizer_info",
        "in_test")
