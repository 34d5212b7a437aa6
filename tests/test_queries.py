"""A cross-section of the registered queries beside DuckDB, on the smallest data."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SHOWN = ["explode_lines", "context_window", "pattern_scan", "composite_scan", "scope", "taint_grade", "flow_grade",
         "flow_steps", "source_to_sink_paths", "iac_line_rules", "absence_rules", "dep_group", "secret_groups",
         "rule_groups", "auth_escalation", "sqli_auth_repo", "template_rce"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


@pytest.mark.parametrize("name", SHOWN)
def test_query_equals_oracle(spark, db, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = db.sql(oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == Counter(
        rel.select(*[f'"{c}"' for c in cols]).fetchall())


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    missing = {q for q in set(queries()) - set(oracle_sql()) if q != "pipeline" and not q.startswith("op")}
    assert missing == {"sarif_document", "json_report"}


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) > 10 and all(r.unique_locations > 0 for r in rows)


def test_line_scans_do_not_shuffle(spark):
    """Lines never cross the network: the scans plan no exchange of their own."""
    from linesieve import queries as reg
    from linesieve.sources import derived
    from linesieve.sources.corpus import corpus_from_table
    from linesieve.operators import composite, files, flow, patterns, secrets, taint
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus = corpus_from_table(docs, "source", "concat('/', doc_id, '.py')", "text")
    src = files.source_lines(files.collect_files(corpus, include_tests=True))
    for df in (patterns.raw_matches(patterns.pattern_facts(src)), composite.condition_hits(composite.composite_facts(src)),
               taint.tainted_pairs(taint.taint_facts(src)), flow.flow_pairs(flow.flow_facts(src)),
               secrets.secret_scan(corpus)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert reg and derived
