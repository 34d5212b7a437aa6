"""The line table and what surrounds a line.

``files`` arguments carry ``lines`` (array<string>, see ``files.source_lines``);
line numbers count from 1. Everything that looks at neighbouring lines works on
that array, inside the row, so lines never cross the network to meet each other.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesieve.catalog import flows
from linesieve.functions.text import (
    block_mark, group, indent_width, is_line_comment, matches, one_of, opens_block, settle, split_lines)

FILE_KEY = ["repo", "path"]
FILE_COLUMNS = ["repo", "path", "ext", "is_test"]
CONTEXT_LINES = 3
#: Lines of a part of a file that is put together from single lines.
PART_LINES = 1 << 14


def explode_lines(corpus: DataFrame) -> DataFrame:
    return (corpus.selectExpr("repo", "path", "ext", f"posexplode({split_lines('content')}) AS (pos, text)")
            .selectExpr("repo", "path", "ext", "pos + 1 AS line_no", "text"))


def line_count(corpus: DataFrame) -> DataFrame:
    """Files and lines per repo, counted without exploding."""
    return (corpus.selectExpr("repo", f"size({split_lines('content')}) AS n")
            .groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("lines")))


def block_marks(lines, opened="false") -> str:
    """A string with one character per line: where block comments open (O) or close (C), a dot elsewhere.

    Before them stands the state above the first line, an O if a block is ``opened`` there. Empty if
    no line is in a block. Looking back in it is a trim of its head, not a search by line.
    """
    marks = f"array_join(transform({lines}, t -> coalesce({block_mark('t')}, '.')), '')"
    return (f"IF({opened} OR exists({lines}, t -> {block_mark('t')} IS NOT NULL), "
            f"concat(IF({opened}, 'O', '.'), {marks}), '')")


def in_block(marks, line_no) -> str:
    """The last mark above the line is an opening one.

    An opening inside a block and a close outside of one change nothing, so the
    last mark alone decides.
    """
    return f"({marks} <> '' AND right(rtrim('.', left({marks}, {line_no})), 1) = 'O')"


def is_comment(text, marks, line_no) -> str:
    """Comment start, block comment start, or inside a block comment."""
    return f"({is_line_comment(text)} OR {opens_block(text)} OR {in_block(marks, line_no)})"


def comment_mask(files: DataFrame) -> DataFrame:
    """Every line with ``is_comment``, by the marks that the scans use; no line leaves its row's task.

    Parts of files (see ``placed_chunks``) start where ``opened`` and ``before`` say. A table of
    single lines is put together to such parts first.
    """
    if "lines" not in files.columns:
        files = placed_chunks(parts_of(files))
    opened, before = ("opened", "before") if "opened" in files.columns else ("false", "0L")
    marked = settle(files, ["repo", "path", "ext", "lines", f"{before} AS lines_before"], {"marks": block_marks("lines", opened)})
    rows = marked.selectExpr("repo", "path", "ext", "lines_before", "marks", "posexplode(lines) AS (pos, text)")
    return rows.selectExpr("repo", "path", "ext", "CAST(lines_before + pos + 1 AS int) AS line_no", "text",
                           f"{is_comment('text', 'marks', '(pos + 1)')} AS is_comment")


def parts_of(lines: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """A line table as parts of files, each of at most ``part_lines`` lines."""
    listed = F.expr("transform(array_sort(collect_list(struct(line_no, text))), l -> l.text)")
    parts = lines.withColumn("chunk", F.expr(f"CAST((line_no - 1) DIV {part_lines} AS bigint)")).groupBy(
        *FILE_KEY, "ext", "chunk").agg(listed.alias("lines"))
    return parts.withColumn("chunks", F.max("chunk").over(Window.partitionBy(*FILE_KEY)) + 1)


def placed_chunks(chunks: DataFrame) -> DataFrame:
    """Parts of files (repo, path, chunk, chunks, lines) with ``opened`` and ``before``: whether the part starts inside a
    block comment, and how many lines the file has above it.

    A part changes the state in one of three ways: it opens, closes or leaves it. These functions,
    with the numbers of lines, are composed over the parts of a file; one row without text stands
    for each part. Files of one part need none of that. A file with an unreadable part drops out.
    """
    whole = chunks.filter("chunks = 1 AND lines IS NOT NULL").selectExpr("*", "false AS opened", "0L AS before")
    large = chunks.filter("chunks > 1")
    last = F.expr(f"try_element_at(filter(transform(lines, t -> {block_mark('t')}), m -> m IS NOT NULL), -1)")
    effects = large.select(*FILE_KEY, "chunk", last.alias("mark"), F.expr("size(lines)").alias("n"), F.expr("lines IS NULL").alias("bad"))
    above = Window.partitionBy(*FILE_KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    states = effects.select(
        *FILE_KEY, "chunk", F.coalesce(F.last("mark", ignorenulls=True).over(above) == "O", F.lit(False)).alias("opened"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).cast("long").alias("before"),
        F.max("bad").over(Window.partitionBy(*FILE_KEY)).alias("bad")).filter("NOT bad").drop("bad")
    return whole.unionByName(large.join(states, [*FILE_KEY, "chunk"]).select(*whole.columns))


def context_before(lines, line_no, k: int = CONTEXT_LINES) -> str:
    first = f"greatest({line_no} - {k}, 1)"
    return f"slice({lines}, {first}, {line_no} - {first})"


def context_after(lines, line_no, k: int = CONTEXT_LINES) -> str:
    return f"slice({lines}, {line_no} + 1, least({k}, size({lines}) - {line_no}))"


def context_window(files: DataFrame) -> DataFrame:
    """Every line with up to three lines on either side."""
    rows = ("transform(lines, (t, i) -> named_struct('line_no', i + 1, 'text', t, "
            f"'context_before', {context_before('lines', '(i + 1)')}, "
            f"'context_after', {context_after('lines', '(i + 1)')}))")
    return files.selectExpr("repo", "path", f"inline({rows})")


def numbered(lines, wanted, near=None) -> str:
    """Lines ``s`` (line_no, text) that satisfy a condition on ``s``; only those numbered in ``near`` are looked at, if given."""
    rows = f"transform({lines}, (t, i) -> named_struct('line_no', i + 1, 'text', t))"
    if near:
        rows = f"transform({near}, n -> named_struct('line_no', n, 'text', get({lines}, n - 1)))"
    return f"filter({rows}, s -> {wanted})"


def by_language(table, build, default, ext="ext") -> str:
    """CASE over the language key: ``build`` gets the entries of one language.

    ``table`` holds (languages, entry) pairs. A line then meets only the
    patterns of its own language.
    """
    langs = {}
    for names, entry in table:
        for name in names.split():
            langs.setdefault(name, []).append(entry)
    groups = {}
    for name, entries in langs.items():
        groups.setdefault(build(entries), []).append(name)
    arms = " ".join(f"WHEN {one_of(ext, names)} THEN {expr}" for expr, names in groups.items())
    return f"CASE {arms} ELSE {default} END"


# -- scope -----------------------------------------------------------------

def _header_name(text, pattern) -> str:
    """First group that took part in the match, or null without one."""
    first = f"nullif({group(text, pattern, 1)}, '')"
    if pattern.count(r"(\w+)") > 1:
        first = f"coalesce({first}, nullif({group(text, pattern, 2)}, ''))"
    return first


def function_name_in(text) -> str:
    return by_language(list(flows.FUNCTION_HEADERS.items()), lambda ps: _header_name(text, ps[0]),
                       _header_name(text, flows.FUNCTION_HEADER_ELSE))


def function_heads(lines) -> str:
    """array<struct<line_no, indent, name, is_test>> of one file."""
    rows = (f"transform({lines}, (t, i) -> named_struct('line_no', i + 1, 'text', t, "
            f"'name', {function_name_in('t')}))")
    kept = f"filter({rows}, h -> h.name IS NOT NULL)"
    test = f"({matches('h.text', flows.TEST_MARK)} OR {matches('h.name', flows.TEST_MARK)})"
    return (f"transform({kept}, h -> named_struct('line_no', h.line_no, 'indent', {indent_width('h.text')}, "
            f"'name', h.name, 'is_test', {test}))")


def class_heads(lines) -> str:
    rows = numbered(lines, matches("s.text", flows.CLASS_HEADER))
    return (f"transform({rows}, s -> named_struct('line_no', s.line_no, 'indent', {indent_width('s.text')}, "
            f"'name', {group('s.text', flows.CLASS_HEADER, 1)}))")


def block_heads(lines) -> str:
    """Lines that open a try or a loop."""
    tries, loops = matches("s.text", flows.TRY_HEADER), matches("s.text", flows.LOOP_HEADER)
    return (f"transform({numbered(lines, f'({tries} OR {loops})')}, s -> named_struct('line_no', s.line_no, "
            f"'indent', {indent_width('s.text')}, 'tries', {tries}, 'loops', {loops}))")


def nearest_head(heads, line_no, indent) -> str:
    """Closest head at or above the line, no deeper than it or at the margin."""
    fits = f"filter({heads}, h -> h.line_no <= {line_no} AND (h.indent <= {indent} OR h.indent = 0))"
    return f"try_element_at({fits}, -1)"


def in_test_scope(heads, line_no, indent) -> str:
    # the indent is bound once, not recomputed for every head
    return f"exists(array({indent}), d -> coalesce({nearest_head(heads, line_no, 'd')}.is_test, false))"


def scopes(targets: DataFrame) -> DataFrame:
    """Function, class, try, loop and test scope of target lines.

    ``targets`` rows carry line_no, indent and the head arrays of their file.
    The upward scan ends once both names are known, so a try or loop header only
    counts down to the higher of the two; the line itself always counts.
    """
    named = targets.selectExpr("*", f"{nearest_head('functions', 'line_no', 'indent')} AS fn",
                               f"{nearest_head('classes', 'line_no', 'indent')} AS cl")
    top = "IF(fn IS NOT NULL AND cl IS NOT NULL, least(fn.line_no, cl.line_no), 1)"
    reaches = (f"b.line_no >= {top} AND b.line_no <= line_no AND (b.indent < indent OR b.line_no = line_no)")
    return named.selectExpr(
        "repo", "path", "line_no", "fn.name AS function_name", "cl.name AS class_name",
        f"exists(blocks, b -> b.tries AND {reaches}) AS in_try",
        f"exists(blocks, b -> b.loops AND {reaches}) AS in_loop",
        "coalesce(fn.is_test, false) AS in_test")
