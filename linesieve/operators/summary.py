"""Counts, risk label and gate per repo."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.functions.text import split_lines

KINDS = ["pattern", "secret", "dependency", "taint", "flow", "composite", "iac", "chain"]
TOTALS = {"pattern": "total_vulnerabilities", "secret": "total_secrets", "dependency": "total_dep_issues",
          "taint": "total_taint_flows", "flow": "total_flow_paths", "composite": "total_composite",
          "iac": "total_iac", "chain": "total_chains"}
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def scanned(collected: DataFrame, include_tests: bool) -> DataFrame:
    """Per repo: all collected files, and the lines of the source files scanned."""
    counted = "kind = 'Source'" if include_tests else "kind = 'Source' AND NOT is_test"
    return collected.selectExpr("repo", f"IF({counted}, size({split_lines('content')}), 0) AS n") \
        .groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("lines"))


def kind_counts(kinds: dict) -> DataFrame:
    """Per repo and kind: rows, rows per severity, sanitized rows.

    Each kind is counted by itself, so only a few rows per repo are shuffled.
    """
    parts = []
    for kind, df in kinds.items():
        clean = F.count_if("is_sanitized") if "is_sanitized" in df.columns else F.lit(0).cast("bigint")
        parts.append(df.groupBy("repo").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES],
            clean.alias("sanitized")).withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, parts)


def scan_summary(lines: DataFrame, kinds: dict) -> DataFrame:
    """Files, lines, totals per kind and severities of pattern findings.

    ``lines`` has repo, files, lines (see ``scanned``).
    """
    counts = kind_counts(kinds)
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(TOTALS[k]) for k in KINDS]
    levels = [F.sum(F.when(F.col("kind") == "pattern", F.col(s.lower()))).alias(s.lower()) for s in SEVERITIES]
    clean = F.sum(F.when(F.col("kind") == "flow", F.col("sanitized"))).alias("sanitized_flows")
    joined = lines.join(counts.groupBy("repo").agg(*sums, *levels, clean), "repo", "left")
    names = [*TOTALS.values(), *[s.lower() for s in SEVERITIES], "sanitized_flows"]
    return joined.fillna(0, names)


def total_issues(summary: DataFrame, more=()) -> DataFrame:
    """Everything but chains and sanitized flows, and the columns ``more`` of the summary."""
    kept = [TOTALS[k] for k in KINDS if k != "chain"]
    return summary.selectExpr("repo", f"{' + '.join(kept)} - sanitized_flows AS total_issues", *more)


def sanitized_split(flows: DataFrame) -> DataFrame:
    return flows.groupBy("repo").agg(F.count_if("is_sanitized").alias("sanitized"),
                                     F.count_if(~F.col("is_sanitized")).alias("unsanitized"))


def risk_label(summary: DataFrame) -> DataFrame:
    return total_issues(summary, ["critical", "high"]).filter("repo IS NOT NULL").selectExpr(
        "repo", "CASE WHEN total_issues = 0 THEN 'NONE' WHEN critical > 0 THEN 'CRITICAL' "
        "WHEN high > 0 THEN 'HIGH' ELSE 'MODERATE' END AS risk")


def gate(summary: DataFrame) -> DataFrame:
    """2 with a critical finding or a chain, 1 with a finding or secret, else 0."""
    return summary.selectExpr(
        "repo", "CASE WHEN critical > 0 OR total_chains > 0 THEN 2 "
        "WHEN total_vulnerabilities > 0 OR total_secrets > 0 THEN 1 ELSE 0 END AS gate")


def findings_by_file(findings: DataFrame) -> DataFrame:
    """Per file: findings, worst score, categories."""
    return findings.groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("findings"), F.min("line_no").alias("first_line"),
        F.array_join(F.array_sort(F.collect_set("category")), " ").alias("categories"))
