"""Configuration rules: lines, and things a whole file lacks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesieve.catalog.iac import FILE_RULES, LINE_RULES
from linesieve.catalog.texts import ADVICE_ELSE
from linesieve.functions.keywords import low_guarded, may_match, with_low
from linesieve.functions.text import any_of, matches, q, settle, split_lines, trimmed
from linesieve.operators.lines import numbered
from linesieve.operators.near import with_near, words_by_language

RULE_SCHEMA = "rule_id string, rule_name string, severity string, cwe string, category string, remediation string"


def file_pattern(path_low, pattern) -> str:
    """``*.x`` is a path suffix, anything else a path part, in lower case."""
    if pattern.startswith("*."):
        return f"endswith({path_low}, {q(pattern[1:])})"
    return f"contains({path_low}, {q(pattern.lower())})"


def file_patterns(path_low, names) -> str:
    return any_of(file_pattern(path_low, n) for n in names.split())


def iac_table(spark: SparkSession) -> DataFrame:
    rows = [(r[0], r[1], r[2], r[3], r[4], ADVICE_ELSE) for r in LINE_RULES]
    rows += [(r[0], r[1], r[2], r[3], r[4], ADVICE_ELSE) for r in FILE_RULES]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def named(hits: DataFrame) -> DataFrame:
    """Rule fields; the rule table has the fixed size of the catalog."""
    return hits.join(F.broadcast(iac_table(hits.sparkSession)), "rule_id").select(
        "repo", "path", "line_no", "rule_id", "rule_name", "category", "severity", "cwe", "remediation", "text")


def rule_files(corpus: DataFrame) -> DataFrame:
    """Adds ``rule_set``: which line rules a file falls under, tested once per file."""
    groups = sorted({r[5] for r in LINE_RULES})
    low = "lower(path)"
    tests = [f"IF({file_patterns(low, g)}, {q(g)}, NULL)" for g in groups]
    return settle(corpus, ["repo", "path", "content"], {
        "rule_sets": f"filter(array({', '.join(tests)}), g -> g IS NOT NULL)"}).filter("size(rule_sets) > 0")


def iac_line_rules(corpus: DataFrame) -> DataFrame:
    """Pattern hit and no negative hit on the same line."""
    by_files = {}
    for rule in LINE_RULES:
        by_files.setdefault(rule[5], []).append(rule[6])
    wanted = any_of(f"(array_contains(rule_sets, {q(names)}) AND {may_match('s.text', own, True)})" for names, own in by_files.items())
    files = rule_files(corpus).selectExpr("repo", "path", "rule_sets", f"{split_lines('content')} AS lines")
    near = with_near(files, {"rule": words_by_language([("", own) for own in by_files.values()])}, ext=None)
    lines = near.selectExpr("repo", "path", "rule_sets", f"inline({numbered('lines', wanted, 'near.rule')})")
    found = []
    for rule_id, _, _, _, _, names, pattern, negative in LINE_RULES:
        test = f"array_contains(rule_sets, {q(names)}) AND {low_guarded('text', pattern)}"
        if negative:
            test += f" AND NOT {matches('text', negative)}"
        found.append(f"IF({test}, {q(rule_id)}, NULL)")
    return named(lines.selectExpr("repo", "path", "line_no", "text",
                                  f"explode({with_low('text', f'filter(array({", ".join(found)}), r -> r IS NOT NULL)')}) AS rule_id"))


def absence_rules(corpus: DataFrame) -> DataFrame:
    """Things a file should have and lacks, one look at its whole text."""
    def has(word):
        return f"contains(content, {q(word)})"

    docker = "contains(low, 'dockerfile') AND NOT endswith(low, '.md')"
    user = (f"exists({split_lines('content')}, t -> startswith({trimmed('t')}, 'USER ') "
            "AND NOT contains(t, 'root'))")
    manifest = f"(endswith(low, '.yaml') OR endswith(low, '.yml')) AND {has('apiVersion:')} AND {has('kind:')}"
    bucket = f"endswith(low, '.tf') AND {has('aws_s3_bucket')}"
    tests = {
        "IAC-DOCKER-010": f"{docker} AND NOT {user}",
        "IAC-DOCKER-011": f"{docker} AND NOT {has('HEALTHCHECK')}",
        "IAC-K8S-010": f"{manifest} AND {has('containers:')} AND NOT {has('resources:')}",
        "IAC-K8S-011": f"{manifest} AND ({has('kind: Deployment')} OR {has('kind: Pod')}) "
                       f"AND NOT {has('NetworkPolicy')}",
        "IAC-TF-010": f"{bucket} AND NOT {has('server_side_encryption')}",
        "IAC-TF-011": f"{bucket} AND NOT {has('versioning')}",
    }
    texts = {r[0]: r[5] for r in FILE_RULES}
    found = [f"IF({test}, named_struct('rule_id', {q(i)}, 'text', {q(texts[i])}), NULL)" for i, test in tests.items()]
    hits = corpus.selectExpr("repo", "path", "content", "lower(path) AS low").selectExpr(
        "repo", "path", "1 AS line_no", f"inline(filter(array({', '.join(found)}), r -> r IS NOT NULL))")
    return named(hits)


def iac_findings(corpus: DataFrame) -> DataFrame:
    return iac_line_rules(corpus).unionByName(absence_rules(corpus))
