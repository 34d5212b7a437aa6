"""Flow tracking: sources, their spread through assignments, and sinks."""

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesieve.catalog import flows
from linesieve.functions.keywords import may_match
from linesieve.functions.names import Names
from linesieve.functions.rows import added_in_rows
from linesieve.functions.text import group, matches, one_of, settle
from linesieve.operators.lines import FILE_COLUMNS, FILE_KEY, by_language, numbered
from linesieve.operators.near import OTHER_LANGUAGES, words_by_language
from linesieve.operators.taint import find_sinks, find_sources, sink_words, source_words

ASSIGN_TYPE = "array<struct<line_no:int,variable:string,side:string,text:string>>"
DERIVED_TYPE = "array<struct<line_no:int,variable:string,root_line:int,root:string,source_type:string,text:string>>"
DERIVED_FIELDS = ["line_no", "variable", "root_line", "root", "source_type", "text"]
DIRECT_DISTANCE = 15
DERIVED_DISTANCE = 20


def find_assignments(lines) -> str:
    """Declared and plain assignments of a file in line order, without repeats."""
    def form(pattern):
        return (f"IF({matches('s.text', pattern)}, named_struct('line_no', s.line_no, "
                f"'variable', {group('s.text', pattern, 1)}, 'side', {group('s.text', pattern, 2)}, "
                "'text', s.text), NULL)")
    # repeats stand on one line only, so that lines are never compared with each other
    both = f"array_distinct(filter(array({form(flows.DECLARATION)}, {form(flows.ASSIGNMENT)}), a -> a IS NOT NULL))"
    wanted = f"contains(s.text, '=') AND {matches('s.text', flows.ASSIGNMENT)}"
    return f"CAST(flatten(transform({numbered(lines, wanted)}, s -> {both})) AS {ASSIGN_TYPE})"


def spread(sources, assigns):
    """Variables that take over taint, each with its root source, of one file.

    A right side that names a source, or a variable tainted on an earlier line,
    taints its target. Taint only moves down the file, so one pass over the
    assignments in line order reaches every depth. Of several tainted parents
    the earliest (line, name) counts. Names are looked up by the parts of a right side that have
    the length of some known name, so the pass takes time in proportion to the text.
    """
    places = {}
    for s in sources:
        places.setdefault(s["variable"], []).append((s["line_no"], s["source_type"]))
    known, fresh, out, line = {}, [], {}, None
    names = Names(places)
    for a in assigns:
        if a["line_no"] != line:  # what a line taints counts from the next line on
            for row in fresh:
                names.add(row[1])
                known[row[1]] = min(row, known.get(row[1], row))
            fresh, line = [], a["line_no"]
        named = names.within(a["side"])
        rows = [(line, a["variable"], at, name, kind) for name in named if name in places
                for at, kind in places[name] if at < line]
        if parents := [known[name] for name in named if name in known]:
            rows.append((line, a["variable"], *min(parents)[2:]))
        for row in rows:
            if row not in out:
                out[row] = a["text"]
                fresh.append(row)
    return [dict(zip(DERIVED_FIELDS, (*row, text))) for row, text in out.items()]


LINK_FIELDS = (f"derived {DERIVED_TYPE}, by_root array<int>, reach array<struct<sink: int, hops: int, at: int, start: int, n: int, "
               "origin: int, clean: boolean>>")


def linked(sources, assigns, sinks, sanitizers):
    """``derived`` variables of a file, their numbers in order of root and line, and what reaches a sink.

    Every derived variable knows its root, so the variables of a root are the tree below it; each
    tree lists its variables in line order, equal ones once. What a direct flow passes above its
    sink is then an interval of a list, and cleaning lines of a variable are found by their number.
    """
    derived = spread(sources, assigns)
    trees = {}
    for i, d in enumerate(derived):
        trees.setdefault((d["root_line"], d["root"]), {}).setdefault((d["line_no"], d["variable"], d["text"]), i)
    by_root, places = [], {}
    for root, own in trees.items():
        steps = sorted(own)
        places[root] = (len(by_root), [step[0] for step in steps])
        by_root += [own[step] for step in steps]
    origins, by_name = {}, {}
    for i, s in enumerate(sources):
        origins.setdefault((s["line_no"], s["variable"]), i)
        by_name.setdefault(s["variable"], []).append((s["line_no"], 0, i))
    for i, d in enumerate(derived):
        by_name.setdefault(d["variable"], []).append((d["line_no"], 1, i))
    names, cleaned, reach = Names(by_name), {}, []
    for z in sanitizers:
        for name in names.within(z["text"]):
            cleaned.setdefault(name, []).append(z["line_no"])
    for entries in by_name.values():
        entries.sort()
    for k, sink in enumerate(sinks):
        for name in names.within(sink["text"]):
            lines = cleaned.get(name, [])
            for at, hops, i in by_name[name]:
                if at >= sink["line_no"]:
                    break
                root = (at, name) if not hops else (derived[i]["root_line"], derived[i]["root"])
                start, steps = places.get(root, (0, [])) if not hops else (0, [])
                after = bisect_right(lines, at)
                reach.append({"sink": k, "hops": hops, "at": i, "start": start, "n": bisect_left(steps, sink["line_no"]),
                              "origin": origins[root], "clean": after < len(lines) and lines[after] <= sink["line_no"]})
    return derived, by_root, reach


def with_links(facts: DataFrame) -> DataFrame:
    """Files with flow sources, with ``derived``, ``by_root`` and ``reach`` in place of their assignments. Rows stay where they are."""
    rows = facts.filter("size(flow_sources) > 0").select(
        *FILE_COLUMNS, "flow_sources", "flow_sinks", "flow_sanitizers", "assigns")
    return added_in_rows(rows, LINK_FIELDS, ["flow_sources", "assigns", "flow_sinks", "flow_sanitizers"], linked, ("assigns", "flow_sanitizers"))


def sanitizer_words() -> dict:
    """Words by language; a call that validates counts in every one."""
    own = words_by_language([(langs, [p, flows.VALIDATE_CALL]) for _, langs, p in flows.FLOW_SANITIZERS])
    return own | {OTHER_LANGUAGES: words_by_language([("", [flows.VALIDATE_CALL])])[""]}


def find_flow_sanitizers(lines, near=None) -> str:
    """Lines that sanitize for the language or call a validating function."""
    table = [(langs, pattern) for _, langs, pattern in flows.FLOW_SANITIZERS]
    both = by_language(table, lambda ps: may_match("s.text", [*ps, flows.VALIDATE_CALL], near),
                       may_match("s.text", [flows.VALIDATE_CALL], near))
    return numbered(lines, both, near)


def words() -> dict:
    """Catalogs of ``near.with_near`` for a scan."""
    return {"flow_source": source_words(flows.FLOW_SOURCES), "flow_sink": sink_words(flows.FLOW_SINKS), "flow_sanitizer": sanitizer_words()}


def seeds(near=False) -> dict:
    return {"flow_sources": find_sources("lines", flows.FLOW_SOURCES, near and "near.flow_source")}


def reached(near=False) -> dict:
    """What a file with flow sources is searched for besides."""
    def where_seeded(expr):
        return f"IF(size(flow_sources) > 0, {expr}, NULL)"
    return {"assigns": where_seeded(find_assignments("lines")),
            "flow_sinks": where_seeded(find_sinks("lines", flows.FLOW_SINKS, near and "near.flow_sink")),
            "flow_sanitizers": where_seeded(find_flow_sanitizers("lines", near and "near.flow_sanitizer"))}


def flow_facts(files: DataFrame) -> DataFrame:
    """Sources, assignments, sinks and sanitizer lines per file."""
    seeded = settle(files, [*FILE_COLUMNS, "lines"], seeds())
    return settle(seeded, [*FILE_COLUMNS, "flow_sources"], reached())


def flow_sources(files: DataFrame) -> DataFrame:
    return files.selectExpr("repo", "path", "ext", f"inline({find_sources('lines', flows.FLOW_SOURCES)})")


def flow_sinks(files: DataFrame) -> DataFrame:
    return files.selectExpr("repo", "path", "ext", f"inline({find_sinks('lines', flows.FLOW_SINKS)})").drop("rank")


def assignments(files: DataFrame) -> DataFrame:
    return files.selectExpr("repo", "path", f"inline({find_assignments('lines')})")


def propagate(facts: DataFrame) -> DataFrame:
    """Derived variables with their root source."""
    return with_links(facts).selectExpr("repo", "path", "inline(derived)")


def flow_pairs(facts: DataFrame) -> DataFrame:
    """Direct (hops 0) and propagated (hops 1) flows, one row per sink and
    reaching variable.

    ``from_line`` is where the reaching variable was last set: the source line of
    a direct flow, the assignment of a propagated one. ``middle`` are the variables that a direct
    flow's source passes to above the sink, or a propagated flow's own variable.
    """
    def via(source, passed):
        return f"IF(r.hops = 0, flow_sources[r.at].{source}, derived[r.at].{passed})"

    def step(i):
        return (f"named_struct('line_no', derived[{i}].line_no, 'variable', derived[{i}].variable, 'text', derived[{i}].text)")

    row = ("named_struct('sink', flow_sinks[r.sink], 'hops', r.hops, "
           f"'from_line', {via('line_no', 'line_no')}, 'variable', {via('variable', 'variable')}, "
           f"'root_line', {via('line_no', 'root_line')}, 'root', {via('variable', 'root')}, "
           f"'source_type', {via('source_type', 'source_type')}, 'is_sanitized', r.clean, 'root_text', flow_sources[r.origin].text, "
           f"'middle', IF(r.hops = 0, transform(slice(by_root, r.start + 1, r.n), i -> {step('i')}), array({step('r.at')})))")
    return with_links(facts).selectExpr(*FILE_COLUMNS, f"inline(transform(reach, r -> {row}))")


def direct_flow(facts: DataFrame) -> DataFrame:
    return flow_pairs(facts).filter("hops = 0")


def propagated_flow(facts: DataFrame) -> DataFrame:
    return flow_pairs(facts).filter("hops = 1")


def flow_grade(pairs: DataFrame) -> DataFrame:
    local = one_of("source_type", flows.LOCAL_SOURCE_TYPES)
    near = f"sink.line_no - root_line < IF(hops = 0, {DIRECT_DISTANCE}, {DERIVED_DISTANCE})"
    return pairs.selectExpr(
        "*",
        f"CASE WHEN is_sanitized OR is_test OR {local} THEN 'LOW' WHEN {near} THEN 'HIGH' "
        "ELSE 'MEDIUM' END AS confidence",
        f"CASE WHEN is_sanitized THEN 'LOW' WHEN is_test THEN 'INFO' WHEN {local} THEN 'LOW' "
        "ELSE sink.severity END AS severity")


def flow_steps(pairs: DataFrame) -> DataFrame:
    """Source, propagations and sink as one ordered array, each with its line's text."""
    def step(line_no, kind, variable, text):
        return f"named_struct('line_no', {line_no}, 'step', '{kind}', 'variable', {variable}, 'text', {text})"

    return pairs.selectExpr("*", f"concat(array({step('root_line', 'source', 'root', 'root_text')}), "
                            f"transform(middle, d -> {step('d.line_no', 'propagation', 'd.variable', 'd.text')}), "
                            f"array({step('sink.line_no', 'sink', 'variable', 'sink.text')})) AS steps")


DESCRIPTION = (
    "concat(source_type, ' in line ', root_line, ' reaches ', sink.sink_type, ' in line ', sink.line_no, "
    "IF(hops = 0, '', concat(' as ', variable, ', taken from ', root, ' in line ', from_line)), "
    "IF(is_sanitized, ', cleaned on the way', ', not cleaned'))")


def flow_id(paths: DataFrame) -> DataFrame:
    """Running number inside a file, in sink, kind and source order."""
    w = Window.partitionBy(*FILE_KEY).orderBy(
        "sink_line", "sink_rank", "hops", "from_line", "variable", "source_line", "source_var", "source_type")
    return paths.withColumn("flow_id", F.format_string("FLOW-%04d", F.row_number().over(w)))


def flow_paths(facts: DataFrame) -> DataFrame:
    rows = flow_steps(flow_grade(flow_pairs(facts))).selectExpr(
        "repo", "path", "ext", "hops", "source_type", "root AS source_var", "root_line AS source_line",
        "from_line", "variable", "sink.sink_type AS sink_type", "sink.line_no AS sink_line",
        "sink.text AS sink_text", "sink.rank AS sink_rank", "sink.cwe AS cwe", "steps", "is_sanitized",
        "confidence", "severity", f"{DESCRIPTION} AS description")
    return flow_id(rows).drop("sink_rank")
