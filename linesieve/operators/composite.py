"""Composite rules: condition trees evaluated on the lines of their languages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesieve.catalog.composite import COMPOSITE_RULES
from linesieve.catalog.texts import ADVICE, ADVICE_ELSE
from linesieve.functions.conditions import context_fields, context_patterns, entry_patterns, guard_patterns, holds
from linesieve.functions.keywords import low_guarded, may_match, with_low
from linesieve.functions.text import one_of, q
from linesieve.operators.lines import FILE_COLUMNS, by_language, numbered
from linesieve.operators.near import words_by_language

RULE_SCHEMA = ("rule_id string, rule_name string, severity string, cwe string, owasp string, "
               "category string, confidence string, remediation string")


def composite_rules():
    return [(row[5], (row[0], row[8])) for row in COMPOSITE_RULES]


def composite_table(spark: SparkSession) -> DataFrame:
    """The catalog, one row per rule."""
    rows = [(r[0], r[1], r[2], r[3], r[4], r[6], r[7], ADVICE.get(r[6], ADVICE_ELSE)) for r in COMPOSITE_RULES]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def entry_words(rules=None) -> dict:
    """Words of the lines that a condition can hold on; None for a language with a tree that is tried on every line."""
    asked = [(langs, entry_patterns(cond)) for langs, (_, cond) in rules or composite_rules()]
    everywhere = {lang for langs, own in asked if own is None for lang in langs.split()}
    return words_by_language([(langs, own) for langs, own in asked if own is not None]) | dict.fromkeys(everywhere)


def guard_words(rules=None) -> dict:
    """Words of the lines that keep a rule from holding near them."""
    return words_by_language([(langs, guard_patterns(cond)) for langs, (_, cond) in rules or composite_rules()])


def context_words(rules=None) -> dict:
    """Words of the lines that rules ask for above theirs."""
    return words_by_language([(langs, context_patterns(cond)) for langs, (_, cond) in rules or composite_rules()])


def held_rules(rules=None, near=None, guards=None, contexts=None) -> str:
    """array<struct<line_no, text, rules>>: lines of a file where conditions hold.

    Comments are not skipped. Nearly every rule needs a match on the line
    itself, so the words and one alternation of these patterns per language
    select the lines; guards and contexts are searched only around those. A tree
    without such a pattern is tried on every line of its languages. ``near``, ``guards`` and ``contexts`` (all or none) number the
    lines near the rules' own patterns, their guards and their contexts.
    """
    rules = rules or composite_rules()

    def entry(entries):
        parts = [entry_patterns(cond) for _, cond in entries]
        if any(p is None for p in parts):
            return "true"
        return may_match("s.text", [p for part in parts for p in part], near)

    asked = {}
    for langs, (_, cond) in rules:
        for p in context_patterns(cond):
            asked.setdefault(p, set()).update(langs.split())
    fields = {p: (f"p{i}", one_of("ext", sorted(langs))) for i, (p, langs) in enumerate(asked.items())}

    def context(pattern):
        return "k.blanks" if pattern is None else f"k.{fields[pattern][0]}"

    def hits(entries):
        found = [f"IF({holds(cond, 's.text', 'lines', 's.line_no', context, guards, low_guarded)}, {q(rule_id)}, NULL)"
                 for rule_id, cond in entries]
        return with_low("s.text", f"filter(array({', '.join(found)}), r -> r IS NOT NULL)")

    found = by_language(rules, hits, "CAST(array() AS array<string>)")
    lines = numbered("lines", by_language(rules, entry, "false"), near)
    held = f"transform(hits, s -> named_struct('line_no', s.line_no, 'text', s.text, 'rules', {found}))"
    if not fields:
        return f"flatten(transform(array({lines}), hits -> {held}))"
    # the strings of a file are made once, and only if one of its lines can meet a rule
    return (f"flatten(transform(filter(array({lines}), hits -> size(hits) > 0), hits -> "
            f"flatten(transform(array({context_fields('lines', fields, contexts)}), k -> {held}))))")


def composite_facts(files: DataFrame, rules=None) -> DataFrame:
    return files.selectExpr(*FILE_COLUMNS, f"{held_rules(rules)} AS held")


def condition_hits(facts: DataFrame) -> DataFrame:
    """(file, line, rule) rows where a condition holds."""
    return (facts.selectExpr(*FILE_COLUMNS, "inline(held)")
            .selectExpr(*FILE_COLUMNS, "line_no", "text", "explode(rules) AS rule_id"))


def composite_scan(facts: DataFrame) -> DataFrame:
    """Composite findings; the rule table has the fixed size of the catalog."""
    return condition_hits(facts).join(F.broadcast(composite_table(facts.sparkSession)), "rule_id").select(
        "repo", "path", "ext", "line_no", "rule_id", "rule_name", "category", "severity", "cwe",
        "owasp", "confidence", "remediation", "text")
