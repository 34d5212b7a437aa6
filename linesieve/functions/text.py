"""Spark SQL expressions for paths, lines and grades.

Helpers take and return SQL text, so the same ones serve columns and lambda
variables, and a catalog of hundreds of patterns becomes one parsed expression.
Everything is a built-in function; no Python runs per row.
"""

from pyspark.sql import DataFrame

from linesieve.catalog import files as fixed


def q(value: str) -> str:
    """SQL string literal; a dollar and brace are not to be read as a variable."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + escaped.replace("${", "$\\u007B") + "'"


BLANKS = q(" \t\r\n\x0b\x0c")


def any_of(flags) -> str:
    return "(" + " OR ".join(flags) + ")"


def contains_any(text, words) -> str:
    return any_of(f"contains({text}, {q(w)})" for w in words)


def starts_with_any(text, words) -> str:
    return any_of(f"startswith({text}, {q(w)})" for w in words)


def ends_with_any(text, words) -> str:
    return any_of(f"endswith({text}, {q(w)})" for w in words)


def one_of(value, words) -> str:
    return f"({value} IN ({', '.join(q(w) for w in words)}))"


def matches(text, pattern) -> str:
    return f"({text} RLIKE {q(pattern)})"


def matches_any(text, patterns) -> str:
    """One literal alternation, so a line is decoded and searched once."""
    return matches(text, "|".join(f"(?:{p})" for p in dict.fromkeys(patterns)))


def group(text, pattern, number=0) -> str:
    return f"regexp_extract({text}, {q(pattern)}, {number})"


def trimmed(text) -> str:
    return f"trim(BOTH {BLANKS} FROM {text})"


def left_trimmed(text) -> str:
    return f"trim(LEADING {BLANKS} FROM {text})"


def base_name(path) -> str:
    return f"substring_index({path}, '/', -1)"


def extension(path) -> str:
    """Lower-cased part after the last dot of the file name, or empty.

    A leading dot alone does not make an extension (``.env`` has none).
    """
    return f"lower({group(path, r'[^/][.]([^./]+)$', 1)})"


def split_lines(content) -> str:
    """Lines of a text: ``\\n`` or ``\\r\\n`` ends a line, no empty last piece."""
    body = f"IF(endswith({content}, {q(chr(10))}), regexp_replace({content}, {q(r'\r?\n\z')}, ''), {content})"
    # a single character is split by without the matcher
    end = f"IF(contains({content}, {q(chr(13))}), {q(r'\r?\n')}, {q(chr(10))})"
    return f"IF({content} = '', CAST(array() AS array<string>), split({body}, {end}))"


def indent_width(text) -> str:
    """Leading blanks, a tab counting four; a blank line has none."""
    rest = f"length({left_trimmed(text)})"
    lead = f"substring({text}, 1, length({text}) - {rest})"
    tabs = f"(length({lead}) - length(replace({lead}, {q(chr(9))}, '')))"
    return f"IF({rest} = 0, 0, length({lead}) + 3 * {tabs})"


def is_test_path(path) -> str:
    low = f"lower({path})"
    return any_of([contains_any(low, fixed.TEST_PATH_PARTS), ends_with_any(low, fixed.TEST_PATH_ENDS)])


def is_blank(text) -> str:
    return f"({left_trimmed(text)} = '')"


def is_line_comment(text) -> str:
    # only the head is trimmed: a trim of both ends reads the whole line, for every mark
    return starts_with_any(left_trimmed(text), fixed.COMMENT_STARTS)


def opens_block(text) -> str:
    return f"startswith({left_trimmed(text)}, '/*')"


def block_mark(text) -> str:
    """'O' where a block comment opens and stays open, 'C' where one closes."""
    return f"CASE WHEN contains({text}, '*/') THEN 'C' WHEN {opens_block(text)} THEN 'O' END"


def case_of(value, table: dict, default) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in table.items())
    return f"CASE {value} {arms} ELSE {default} END"


def severity_score(label) -> str:
    return case_of(f"upper({label})", fixed.SEVERITY_SCORES, 1)


def report_level(label) -> str:
    return case_of(f"upper({label})", {k: q(v) for k, v in fixed.REPORT_LEVELS.items()}, q("warning"))


def report_score(label) -> str:
    return case_of(f"upper({label})", {k: q(v) for k, v in fixed.REPORT_SCORES.items()}, q("1.0"))


def relative_path(path, root) -> str:
    """Drop a leading root and the slashes after it; other paths stay."""
    rest = f"trim(LEADING '/' FROM substring({path}, {len(root) + 1}))"
    return f"IF(startswith({path}, {q(root)}), {rest}, {path})"


def fingerprint(rule_id, path, line_no) -> str:
    return f"sha2(concat({rule_id}, ':', {path}, ':', {line_no}), 256)"


def version_parts(version) -> str:
    """Leading digits of each dotted part; parts without digits vanish."""
    digits = f"transform(split({version}, {q('[.]')}), p -> {group('p', '^([0-9]+)', 1)})"
    return f"filter(transform({digits}, d -> IF(d = '', NULL, try_cast(d AS bigint))), n -> n IS NOT NULL)"


def version_below(version, threshold) -> str:
    """Numeric comparison part by part, the shorter side padded with zeros."""
    a, b = version_parts(version), version_parts(threshold)

    def padded(x, y):
        return f"concat({x}, array_repeat(0L, greatest(size({y}) - size({x}), 0)))"
    return f"({padded(a, b)} < {padded(b, a)})"


def redacted(text, patterns, keep, whole) -> str:
    """Hide group 1 of every match of every pattern, the longest values first.

    A value of ``whole`` characters or more keeps a prefix of ``keep``, at most a
    quarter of it; a shorter one keeps nothing.
    """
    found = ", ".join(f"regexp_extract_all({text}, {q(p)}, 1)" for p in patterns)
    values = (f"array_sort(array_distinct(transform(filter(flatten(array({found})), v -> v <> ''), "
              "v -> named_struct('n', -length(v), 'v', v))))")
    hidden = f"concat(IF(length(s.v) < {whole}, '', left(s.v, least({keep}, length(s.v) DIV 4))), '****')"
    return f"aggregate({values}, {text}, (t, s) -> replace(t, s.v, {hidden}))"


def settle(df: DataFrame, keep, columns: dict) -> DataFrame:
    """Add computed columns that later steps read but do not recompute.

    A plain projection may be merged into the steps above it, which would run an
    expensive expression once per reference (or once per array element inside a
    lambda). A generator over a one-row array is never merged.
    """
    fields = ", ".join(f"{q(name)}, {expr}" for name, expr in columns.items())
    return df.selectExpr(*keep, f"inline(array(named_struct({fields})))")
