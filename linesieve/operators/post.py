"""Result tables after the scans: dedupe, filters, caps, groups, one stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.functions.text import q, severity_score
from linesieve.operators.secrets import top_rows

SHOWN_LOCATIONS = 5
# Optional result limits per kind.
RESULT_CAPS = {"pattern": 50000, "taint": 50000, "composite": 50000, "secret": 10000, "flow": 5000}
TOP_LISTS = {"taint": 50, "flow": 30, "iac": 50}


def finding_dedupe(findings: DataFrame) -> DataFrame:
    """One per rule, path and line: the least matched text, so the result does
    not depend on row order. Partial aggregation, no window."""
    others = [c for c in findings.columns if c not in ("rule_id", "repo", "path", "line_no")]
    best = findings.groupBy("rule_id", "repo", "path", "line_no").agg(
        F.min(F.struct("matched_text", *[c for c in others if c != "matched_text"])).alias("best"))
    return best.select("rule_id", "repo", "path", "line_no", "best.*").select(*findings.columns)


def cross_engine_anti(findings: DataFrame, composites: DataFrame) -> DataFrame:
    """Pattern rows on a line that a composite rule also reports go away."""
    places = composites.select("repo", "path", "line_no")
    return findings.join(places, ["repo", "path", "line_no"], "left_anti")


def min_severity(rows: DataFrame, label: str) -> DataFrame:
    return rows.filter(f"{severity_score('severity')} >= {severity_score(q(label))}")


def severity_sort(rows: DataFrame) -> DataFrame:
    """Total order: score, then place and rule."""
    return rows.withColumn("score", F.expr(severity_score("severity"))).orderBy(
        F.desc("score"), "repo", "path", "line_no", "rule_id")


def result_caps(rows: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` most severe rows (a top-k report, off by default)."""
    return severity_sort(rows).limit(cap)


def rule_groups(findings: DataFrame) -> DataFrame:
    """Per rule name: rows, the first row's fields, up to five places."""
    order = ["repo", "path", "line_no", "rule_id"]
    counts = findings.groupBy("rule_name").agg(F.count(F.lit(1)).alias("occurrences"))
    first = top_rows(findings.select("rule_name", "rule_id", "severity", "cwe", "repo", "path", "line_no"),
                     ["rule_name"], order, SHOWN_LOCATIONS)
    shown = first.groupBy("rule_name").agg(
        F.min_by("rule_id", "rn").alias("rule_id"), F.min_by("severity", "rn").alias("severity"),
        F.min_by("cwe", "rn").alias("cwe"),
        F.expr("array_join(transform(array_sort(collect_list(struct(rn, path, line_no))), "
               "p -> concat(p.path, ':', p.line_no)), ' ')").alias("locations"))
    return counts.join(shown, "rule_name")


ALL_COLUMNS = ["kind", "repo", "path", "line_no", "rule_key", "severity", "message"]


def all_findings(kinds: dict) -> DataFrame:
    """One normalized stream of the given result kinds.

    ``kinds`` maps pattern, composite, taint, flow, secret, iac, dependency and
    chain to their tables; missing kinds are left out.
    """
    shapes = {
        "pattern": ("line_no", "rule_id", "rule_name"),
        "composite": ("line_no", "rule_id", "rule_name"),
        "iac": ("line_no", "rule_id", "rule_name"),
        "secret": ("line_no", "concat('SECRET-', upper(replace(rule_name, ' ', '-')))", "description"),
        "taint": ("sink.line_no", "concat('TAINT-', upper(sink.sink_type))", "description"),
        "flow": ("sink_line", "concat('FLOW-', upper(sink_type))", "description"),
        "dependency": ("1", "concat('DEP-', upper(replace(vulnerability, ' ', '-')))",
                       "concat(package_name, '@', version, ': ', vulnerability)"),
        "chain": ("line_no", "concat('CHAIN-', upper(replace(title, ' ', '-')))", "title"),
    }
    parts = [df.selectExpr(f"'{kind}' AS kind", "repo", "path", f"CAST({line} AS int) AS line_no",
                           f"{key} AS rule_key", "severity", f"{message} AS message")
             for kind, df in kinds.items() for line, key, message in [shapes[kind]]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


TOP_SHAPES = {
    "taint": ("sink.line_no", "concat_ws(' ', sink.sink_type, source.line_no, source.variable)"),
    "flow": ("sink_line", "concat_ws(' ', sink_type, from_line, variable, source_line, source_var, source_type)"),
    "iac": ("line_no", "rule_id"),
}


def top_lists(kinds: dict) -> DataFrame:
    """The first rows of taints, flows and configuration findings, in place order."""
    lists = []
    for kind, (line, label) in TOP_SHAPES.items():
        rows = kinds[kind].selectExpr("path", f"CAST({line} AS int) AS line_no", f"{label} AS label", "severity")
        best = top_list(rows, TOP_LISTS[kind], ["path", "line_no", "label", "severity"])
        lists.append(best.selectExpr(f"'{kind}' AS kind", "*"))
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


def top_list(rows: DataFrame, k: int, order) -> DataFrame:
    """First k rows of one kind, ranked. A report feature: the limit is a top-k
    over partitions, and only its k rows are numbered."""
    best = rows.orderBy(*order).limit(k)
    fields = ", ".join(best.columns)
    # at most k rows remain
    ranked = best.groupBy().agg(F.expr(f"array_sort(collect_list(struct({', '.join(order)}, "
                                       f"struct({fields}) AS row)))").alias("rows"))
    return ranked.selectExpr("posexplode(rows) AS (pos, item)").selectExpr("pos + 1 AS rank", "item.row.*")
