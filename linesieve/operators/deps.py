"""Dependency manifests against advisories."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesieve.catalog.advisories import (
    ADVISORIES, EXTRACTORS, MANIFESTS, MAVEN_RUN, MAVEN_VERSION, RISKY_LINES, UNKNOWN_VERSION)
from linesieve.functions.text import base_name, case_of, group, matches, q, split_lines, trimmed, version_below
from linesieve.operators.secrets import top_rows

ADVISORY_SCHEMA = "ecosystem string, package_key string, affected_below string, advisory string, advisory_severity string"
SHOWN_FILES = 3


def advisory_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADVISORIES, ADVISORY_SCHEMA)


def manifest_route(corpus: DataFrame) -> DataFrame:
    """Extractor and ecosystem of a manifest by its file name."""
    def route(part):
        return case_of(base_name("path"), {n: q(m[part]) for m in MANIFESTS for n in m[2].split()}, "NULL")
    return corpus.selectExpr("*", f"{route(0)} AS extractor", f"{route(1)} AS ecosystem")


def manifest_deps(corpus: DataFrame) -> DataFrame:
    """(package, version) pairs; a missing version reads ``unknown``."""
    def pairs(extractor):
        if extractor == "maven":
            runs = f"arrays_zip(regexp_extract_all(content, {q(MAVEN_RUN)}, 1), regexp_extract_all(content, {q(MAVEN_RUN)}, 2))"
            found = f"transform({runs}, r -> named_struct('0', r.`0`, '1', {group('r.`1`', MAVEN_VERSION, 1)}))"
            return f"filter({found}, r -> r.`1` <> '')"
        parts = [f"arrays_zip(regexp_extract_all(content, {q(p)}, {a}), "
                 f"regexp_extract_all(content, {q(p)}, {b}))" for p, a, b in EXTRACTORS[extractor]]
        return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"

    found = case_of("extractor", {e: pairs(e) for e in EXTRACTORS}, "NULL")
    routed = manifest_route(corpus).filter("extractor IS NOT NULL")
    return (routed.selectExpr("repo", "path", "ecosystem", f"inline({found}) AS (package, version)")
            .selectExpr("repo", "path", "ecosystem", "package",
                        f"IF(version = '', {q(UNKNOWN_VERSION)}, version) AS version"))


def advisory_match(deps: DataFrame, exact: bool = False) -> DataFrame:
    """Affected packages. A package name containing the advisory's counts unless
    ``exact``. The advisory table has the fixed size of the catalog."""
    name = "lower(package) = package_key" if exact else "contains(lower(package), package_key)"
    joined = deps.join(F.broadcast(advisory_table(deps.sparkSession)), "ecosystem").filter(name)
    return joined.filter(version_below("version", "affected_below")).selectExpr(
        "repo", "path", "ecosystem AS package_manager", "package AS package_name", "version",
        "concat(advisory, ': ', package_key, ' below ', affected_below) AS vulnerability",
        "advisory_severity AS severity", "concat('Use ', affected_below, ' or newer') AS advice")


def risky_dep_lines(corpus: DataFrame) -> DataFrame:
    """Plaintext protocols and database drivers on any manifest line."""
    lines = corpus.selectExpr("repo", "path", f"explode({split_lines('content')}) AS text")
    found = [f"IF({matches('text', p)}, named_struct('vulnerability', {q(v)}, 'severity', {q(s)}), NULL)"
             for s, v, p in RISKY_LINES]
    return (lines.selectExpr("repo", "path", "text", f"inline(filter(array({', '.join(found)}), r -> r IS NOT NULL))")
            .selectExpr("repo", "path", "'any' AS package_manager", f"{trimmed('text')} AS package_name",
                        "'' AS version", "vulnerability", "severity",
                        "'Prefer an encrypted transport' AS advice"))


def dep_findings(corpus: DataFrame, exact: bool = False) -> DataFrame:
    return advisory_match(manifest_deps(corpus), exact).unionByName(risky_dep_lines(corpus))


def dep_group(findings: DataFrame) -> DataFrame:
    """By package, version and vulnerability: rows, distinct files, first three.

    Files are counted over pre-aggregated (group, file) rows.
    """
    keys = ["package_name", "version", "vulnerability"]
    files = findings.groupBy(*keys, "path").agg(F.count(F.lit(1)).alias("n"), F.min("severity").alias("severity"))
    counts = files.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("files"),
                                      F.min("severity").alias("severity"))
    shown = (top_rows(files, keys, ["path"], SHOWN_FILES).groupBy(*keys)
             .agg(F.array_join(F.array_sort(F.collect_list("path")), " ").alias("first_files")))
    return counts.join(shown, keys)
