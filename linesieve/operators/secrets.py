"""Credentials in text: scan, redaction, grouping."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesieve.catalog.secrets import (
    BODY_LINE, HIDDEN_ONLY, KEY_BEGIN, KEY_END, KEY_HEADER, OPEN_VALUE, REDACT_KEEP, REDACT_WHOLE, SECRET_RULES, SHORT_BODY_LINE)
from linesieve.functions.keywords import guarded, low_guarded, may_match, with_low
from linesieve.functions.text import is_blank, matches, q, redacted, split_lines
from linesieve.operators.lines import numbered
from linesieve.operators.near import with_near, words_by_language

SHOWN_LOCATIONS = 3


def found_rules(text, rules=None) -> str:
    """array<struct> of the credential rules a line meets."""
    found = [f"IF({low_guarded(text, p)}, named_struct('rule_name', {q(name)}, 'description', {q(about)}, "
             f"'severity', {q(severity)}), NULL)" for name, about, severity, p in rules or SECRET_RULES]
    return with_low(text, f"filter(array({', '.join(found)}), r -> r IS NOT NULL)")


def secret_scan(corpus: DataFrame, rules=None) -> DataFrame:
    """Line x credential pattern, comments included. Narrow from end to end."""
    return secrets_of(secret_facts(corpus.selectExpr("repo", "path", f"{split_lines('content')} AS lines"), rules), rules)


def secret_words(rules=None) -> dict:
    return words_by_language([("", [r[3] for r in rules or SECRET_RULES])])


def secret_lines(near=None, rules=None) -> str:
    """array<struct<line_no, text>> of the lines of a file that may hold one."""
    return numbered("lines", may_match("s.text", [r[3] for r in rules or SECRET_RULES], near), near)


def secret_facts(files: DataFrame, rules=None) -> DataFrame:
    near = with_near(files.select("repo", "path", "lines"), {"secret": secret_words(rules)}, ext=None)
    return near.selectExpr("repo", "path", f"{secret_lines('near.secret', rules)} AS secret_lines")


def secrets_of(facts: DataFrame, rules=None) -> DataFrame:
    """``secret_scan`` of files whose lines were looked at already."""
    rows = facts.selectExpr("repo", "path", "inline(secret_lines)")
    return rows.selectExpr("repo", "path", "line_no", "text", f"inline({found_rules('text', rules)})")


def masked_blocks(lines) -> str:
    """The lines of a file with every line of a credential that goes over several lines replaced by ``****``.

    Each line becomes one character: B opens a key block or an unfinished value, b is nothing but
    encoded text, s a short piece of it, E ends a key block. The run of b behind a B belongs to it,
    with one s in front of an E, whatever blank lines stand between. The run is marked in that
    string, once per file; files without a line of encoded text are not looked at further.
    """
    mark = (f"CASE WHEN {matches('t', KEY_END)} THEN 'E' WHEN {matches('t', KEY_BEGIN)} THEN 'B' WHEN {matches('t', BODY_LINE)} THEN 'b' "
            f"WHEN {guarded('t', OPEN_VALUE)} THEN 'B' WHEN {is_blank('t')} THEN '_' WHEN {matches('t', SHORT_BODY_LINE)} THEN 's' "
            f"WHEN {matches('t', KEY_HEADER)} THEN 'b' ELSE '.' END")
    marks = f"array_join(transform({lines}, t -> {mark}), '')"
    runs = f"regexp_replace({marks}, {q(r'(\G(?!\A)|B)([b_])')}, '$1x')"
    runs = f"regexp_replace({runs}, {q(r'([xB])s(?=_*E)')}, '$1x')"
    hidden = f"flatten(transform(array(split({runs}, '')), m -> transform({lines}, (t, i) -> IF(m[i] = 'x' AND NOT {is_blank('t')}, '****', t))))"
    return f"IF(exists({lines}, t -> length(t) >= 16 AND {matches('t', BODY_LINE)}), {hidden}, {lines})"


def without_secrets(text, rules=None, more=()) -> str:
    """The text with the values of all credential rules hidden; most texts have none and are only asked for words."""
    patterns = [*[r[3] for r in rules or SECRET_RULES], *more]
    return f"IF({may_match(text, patterns)}, {redacted(text, patterns, REDACT_KEEP, REDACT_WHOLE)}, {text})"


def redact(secrets: DataFrame, rules=None, more=()) -> DataFrame:
    """``redacted``: the line with every value hidden that any rule finds on it, or a pattern of ``more``."""
    return secrets.selectExpr("*", f"{without_secrets('text', rules, more)} AS redacted")


def hide_secrets(rows: DataFrame, texts=(), arrays=()) -> DataFrame:
    """Rows whose named text columns and text arrays hide every credential, also the part of one that goes on below.

    Lines of nothing but a credential are hidden before, see ``masked_blocks``. The texts of a row pass through one expression, as one
    array, and those of its arrays through another, so that a table that asks for no array does no work for one.
    """
    texts, arrays = list(texts), list(arrays)
    at, columns, hidden = "0", {t: f"hidden_texts[{i}]" for i, t in enumerate(texts)}, {}
    for a in arrays:
        columns[a] = f"IF({a} IS NULL, NULL, slice(hidden_lines, {at} + 1, size({a})))"
        at += f" + coalesce(size({a}), 0)"
    if texts:
        hidden["hidden_texts"] = f"array({', '.join(texts)})"
    if arrays:
        hidden["hidden_lines"] = f"concat({', '.join(f'coalesce({a}, array())' for a in arrays)})"
    kept = rows.selectExpr("*", *[f"transform({all_of}, h -> {without_secrets('h', more=HIDDEN_ONLY)}) AS {name}" for name, all_of in hidden.items()])
    return kept.selectExpr(*[f"{columns[c]} AS {c}" if c in columns else c for c in rows.columns])


def secret_dedupe(secrets: DataFrame) -> DataFrame:
    """One per rule, path and line."""
    return secrets.dropDuplicates(["rule_name", "repo", "path", "line_no"])


def top_rows(df: DataFrame, keys, order, k: int) -> DataFrame:
    """First k rows per group.

    Spark turns the row_number filter into a group limit that keeps k rows per
    group and partition before the shuffle, so a group with most of the rows
    does not land in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def secret_groups(secrets: DataFrame) -> DataFrame:
    """Per rule: rows, distinct places, the first three places.

    Places are counted over pre-aggregated (rule, place) rows, so a rule with
    most of the findings is spread over the places.
    """
    places = secrets.groupBy("rule_name", "description", "severity", "path", "line_no").agg(
        F.count(F.lit(1)).alias("n"))
    counts = places.groupBy("rule_name", "description", "severity").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_locations"))
    shown = (top_rows(places, ["rule_name"], ["path", "line_no"], SHOWN_LOCATIONS)
             .groupBy("rule_name").agg(F.expr(
                 "array_join(transform(array_sort(collect_list(struct(path, line_no))), "
                 "p -> concat(p.path, ':', p.line_no)), ' ')").alias("locations")))
    return counts.join(shown, "rule_name")
