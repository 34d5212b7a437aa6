import random

import pytest

from linesieve.catalog.examples import credential_lines
from linesieve.functions.text import q, redacted, version_below
from linesieve.operators import deps, iac, paths, post, secrets, summary
from linesieve.catalog.secrets import SECRET_RULES
from linesieve.sources.corpus import corpus_from_table


def corpus(spark, texts):
    df = spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repo string, path string, content string")
    return corpus_from_table(df, "repo", "path", "content")


def test_version_below(spark):
    cases = {("1.2.5", "1.2.6"): True, ("2.0", "2.0.0"): False, ("10.0.0", "9.9.9"): False, ("unknown", "1.0"): True,
             ("1.2.6", "1.2.6"): False, ("1.x.3", "1.2"): False, ("1.2b1", "1.3"): True}
    for (a, b), want in cases.items():
        assert spark.range(1).selectExpr(f"{version_below(q(a), q(b))} AS v").first().v is want, (a, b)


def test_manifests(spark):
    found = deps.manifest_deps(corpus(spark, {
        "/Gemfile": "gem 'rails'\ngem 'rack', '~> 2.0.1'", "/Cargo.toml": 'h2 = "0.3.1"\nhyper = { version = "1.0.0" }',
        "/pom.xml": "<artifactId>gson</artifactId>\n<scope>x</scope><version>2.8.1</version>", "/go.mod": "\texample.com/a v1.2.3",
        "/notes.txt": "rails==1.0"}))
    assert {(r.package, r.version) for r in found.collect()} == {
        ("rails", "unknown"), ("rack", "2.0.1"), ("h2", "0.3.1"), ("hyper", "1.0.0"), ("gson", "2.8.1"),
        ("example.com/a", "1.2.3")}
    assert {r.package_name for r in deps.advisory_match(found).collect()} == {"rails", "rack", "h2", "hyper", "gson"}


def test_long_manifests_do_not_overflow(spark):
    """100,000 elements between a name and its version, and repetitions for every other extractor."""
    many = 100_000
    texts = {"/pom.xml": "<artifactId>gson</artifactId>" + "<a>b</a>\n" * many + "<version>2.8.1</version></dependency>"
             + "<artifactId>x</artifactId><version>1</version><scope>t</scope><version>2</version>",
             "/package.json": '"a": "1.2.3",\n' * many, "/Cargo.toml": "h = { " + "x = 1, " * many + 'version = "1.2.3" }',
             "/go.mod": "e.com/a v1.2.3\n" * many, "/Gemfile": "gem 'a'" + " " * many, "/build.gradle": "api" + " " * many + "'a:b:1'"}
    found = {(r.path, r.package): r["count"] for r in deps.manifest_deps(corpus(spark, texts)).groupBy("path", "package").count().collect()}
    assert found == {("/pom.xml", "gson"): 1, ("/pom.xml", "x"): 1, ("/package.json", "a"): many, ("/Cargo.toml", "h"): 1,
                     ("/go.mod", "e.com/a"): many, ("/Gemfile", "a"): 1, ("/build.gradle", "b"): 1}
    last = deps.manifest_deps(corpus(spark, {"/pom.xml": texts["/pom.xml"]})).filter("package = 'x'").first()
    assert last.version == "2"


def test_advisory_names_match_by_part_or_exactly(spark):
    found = deps.manifest_deps(corpus(spark, {"/Gemfile": "gem 'rack-test', '1.0'\ngem 'rack', '1.0'"}))
    assert {r.package_name for r in deps.advisory_match(found).collect()} == {"rack-test", "rack"}
    assert {r.package_name for r in deps.advisory_match(found, exact=True).collect()} == {"rack"}


def test_iac(spark):
    files = corpus(spark, {"/a/Dockerfile": "FROM x:latest\nUSER app\n", "/b/dockerfile.md": "x", "/c/main.tf": "aws_s3_bucket",
                           "/d/k.yaml": "apiVersion: 1\nkind: Pod\ncontainers:"})
    got = {(r.path, r.rule_id) for r in iac.iac_findings(files).collect()}
    assert ("/a/Dockerfile", "IAC-DOCKER-001") in got and ("/a/Dockerfile", "IAC-DOCKER-010") not in got
    assert ("/a/Dockerfile", "IAC-DOCKER-011") in got and not any(p == "/b/dockerfile.md" for p, _ in got)
    assert {r for p, r in got if p == "/c/main.tf"} == {"IAC-TF-010", "IAC-TF-011"}
    assert {r for p, r in got if p == "/d/k.yaml"} == {"IAC-K8S-010", "IAC-K8S-011"}


def test_every_secret_rule_fires_and_hides(spark):
    rows = secrets.redact(secrets.secret_scan(corpus(spark, {f"/{i}.py": t for i, t in enumerate(credential_lines().values())})))
    got = {(r.rule_name, r.text): r.redacted for r in rows.collect()}
    for name, text in credential_lines().items():
        assert (name, text) in got and "****" in got[name, text], name
    assert {r[0] for r in SECRET_RULES} == set(credential_lines())
    def hidden(text):
        return spark.range(1).selectExpr(f"{redacted(q(text), [r[3] for r in SECRET_RULES], 4, 12)} AS v").first().v

    assert hidden("none") == "none" and hidden("password = 'abcd'") == "password = '****'"
    assert hidden("pwd='first1' pwd='second2' api_key='abcdefghijklmnop'") == "pwd='****' pwd='****' api_key='abcd****'"


def test_dedupe_and_cross_engine(spark):
    cols = "rule_id string, repo string, path string, line_no int, matched_text string"
    rows = spark.createDataFrame([("A", "r", "p", 1, "b"), ("A", "r", "p", 1, "a"), ("B", "r", "p", 2, "c")], cols)
    once = post.finding_dedupe(rows)
    assert sorted((r.rule_id, r.matched_text) for r in once.collect()) == [("A", "a"), ("B", "c")]
    assert post.finding_dedupe(once).count() == 2
    places = spark.createDataFrame([("r", "p", 2)], "repo string, path string, line_no int")
    assert [r.rule_id for r in post.cross_engine_anti(once, places).collect()] == ["A"]


def test_groups_of_a_hot_rule_stay_small(spark):
    rows = spark.range(5000).selectExpr("IF(id < 4999, 'hot', 'rare') AS rule_name", "'R' AS rule_id", "'HIGH' AS severity", "'CWE-1' AS cwe",
                                        "'r' AS repo", "concat('/f', lpad(id, 5, '0')) AS path", "1 AS line_no")
    groups = post.rule_groups(rows)
    row = groups.filter("rule_name = 'hot'").first()
    assert row.occurrences == 4999 and row.locations.split() == [f"/f{i:05d}:1" for i in range(5)]
    assert "WindowGroupLimit" in groups._jdf.queryExecution().toString()


def test_gate(spark):
    cols = "repo string, critical int, total_chains int, total_vulnerabilities int, total_secrets int"
    rows = spark.createDataFrame([("chain", 0, 1, 0, 0), ("secret", 0, 0, 0, 1), ("taint", 0, 0, 0, 0)], cols)
    assert {r.repo: r.gate for r in summary.gate(rows).collect()} == {"chain": 2, "secret": 1, "taint": 0}


def test_paths(spark):
    kinds = {0: "Source", 1: "Assignment", 2: "Sanitizer", 3: "Sink", 4: "Assignment"}
    nodes = spark.createDataFrame(list(kinds.items()), "id long, node_type string")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (1, 4), (4, 1)], "src long, dst long")
    got = {tuple(r.path): r.is_sanitized for r in paths.simple_paths(nodes, edges, 8).collect()}
    assert got == {(0, 1, 3): False, (0, 2, 3): True}
    assert [(r.source_id, r.sink_id, r.path, r.length) for r in paths.witness_paths(nodes, edges, 8).collect()] == [(0, 3, [0, 1, 3], 3)]


def listed(kinds, edges, max_nodes):
    """All simple paths to the first sink by plain depth-first search."""
    out, ahead = {}, {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)

    def walk(path):
        for node in ahead.get(path[-1], ()):
            if node in path:
                continue
            if kinds[node] == "Sink":
                out[(*path, node)] = any(kinds[n] == "Sanitizer" for n in path[1:])
            elif len(path) + 1 < max_nodes:
                walk((*path, node))

    for node, kind in kinds.items():
        if kind == "Source" and max_nodes > 1:
            walk((node,))
    return out


@pytest.mark.parametrize("seed, max_nodes", [(1, 7), (2, 12), (3, 2), (4, 3)])
def test_paths_against_a_plain_search(spark, seed, max_nodes):
    """Random graphs with a hub, dead ends, cycles and sinks behind sinks."""
    rnd = random.Random(seed)
    kinds = {i: rnd.choice(["Source", "Assignment", "Assignment", "Sanitizer", "Sink", "Return"]) for i in range(26)}
    kinds[0] = "Assignment"  # the hub
    edges = {(rnd.randrange(26), rnd.randrange(26)) for _ in range(34)} | {(0, i) for i in range(1, 26, 3)} | {(i, 0) for i in range(2, 26, 4)}
    edges = sorted((a, b) for a, b in edges if a != b)
    nodes = spark.createDataFrame(list(kinds.items()), "id long, node_type string")
    table = spark.createDataFrame(edges, "src long, dst long")
    want = listed(kinds, edges, max_nodes)
    got = [(tuple(r.path), r.is_sanitized, r.source_id, r.sink_id, r.length) for r in paths.simple_paths(nodes, table, max_nodes).collect()]
    assert len(got) == len(want) and {g[0]: g[1] for g in got} == want
    assert all(g[2:] == (g[0][0], g[0][-1], len(g[0])) for g in got)
    shortest = {}
    for path in want:
        key = (path[0], path[-1])
        shortest[key] = min(shortest.get(key, path), path, key=lambda p: (len(p), p))
    if max_nodes > 3:
        seen = {(r.source_id, r.sink_id): tuple(r.path) for r in paths.witness_paths(nodes, table, max_nodes).collect()}
        assert seen == shortest


def test_witnesses_without_a_limit_and_distances(spark):
    """A chain of 40 nodes, a cycle and a branch without a sink."""
    n = 40
    kinds = {0: "Source", n - 1: "Sink", 100: "Assignment", 101: "Assignment"}
    nodes = spark.createDataFrame([(i, kinds.get(i, "Assignment")) for i in [*range(n), 100, 101]], "id long, node_type string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(20, 3), (5, 100), (100, 101), (101, 100)], "src long, dst long")
    assert paths.witness_paths(nodes, edges).collect() == []
    row, = paths.witness_paths(nodes, edges, None).collect()
    assert list(row.path) == list(range(n)) and (row.source_id, row.sink_id, row.length) == (0, n - 1, n)
    labels = {r.node: r.distance for r in paths.sink_distances(nodes, edges).collect()}
    assert labels == {i: n - 1 - i for i in range(n)}
    assert {r.node for r in paths.sink_distances(nodes, edges, 7).collect()} == set(range(n - 8, n))


def test_no_report_join_gathers_a_key(spark):
    """Without broadcasts, every join of report rows is dealt by a salt besides its key."""
    from linesieve.plans import report
    cols = ("kind string, repo string, path string, line_no int, rule_key string, rule_name string, tag string, precision string, severity string, "
            "message string, snippet string, fingerprint string, confidence string, category string, advice string, "
            f"code_flow {report.STEP_TYPE}, related {report.RELATED_TYPE}")
    rows = spark.createDataFrame([("pattern", "r", f"/{i}", i, "K", "n", "t", "high", "HIGH", "m", "s", f"f{i}", None, "c", "a", [], [])
                                  for i in range(50)], cols)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (report.sarif_results(rows), report.sarif_document(rows, per_run=20)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            joins = [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
            assert joins and all("salt" in line for line in joins), plan
        documents = report.sarif_document(rows, per_run=20).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(documents) > 1 and sum(d.document.count('"ruleId":"K"') for d in documents) == 50
    assert all('"$schema"' in d.document and '"shortDescription"' in d.document for d in documents)


def test_tables_of_a_scan_are_planned_when_asked_for(spark):
    """No job before a table is asked for; a kind or the summary runs the shared writes it needs and no others."""
    from linesieve.plans.scan import scan
    code = "q = request.args\neval(q)\nz = q\nos.system(z)\npassword = 'hunter22secret'"
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext

    def jobs(name, run):
        context.setJobGroup(name, name)
        made = run()
        context.setLocalProperty("spark.jobGroup.id", None)
        return made, len(tracker.getJobIdsForGroup(name))

    result, n = jobs("plan", lambda: scan(corpus(spark, {"/a.py": code, "/b.py": code}), include_tests=True))
    assert n == 0
    secret, n = jobs("secret", lambda: result.kinds["secret"])
    assert n == 1 and secret.count() > 0  # the facts
    _, n = jobs("pattern", lambda: [result.kinds[k] for k in ("pattern", "composite", "taint", "flow", "iac", "dependency")])
    assert n == 0
    counts, n = jobs("summary", result.summary)
    assert n <= 6 and counts.first().total_taint_flows == 2
    _, n = jobs("again", lambda: (result.summary(), result.kinds["chain"]))
    assert n == 0


def test_the_few_fields_of_a_report_join_are_measured(spark):
    """Counted from a table beyond the limit of broadcasts, the totals of a few repos still meet its rows where they are."""
    from linesieve.plans import report
    rows = spark.range(20000).selectExpr("concat('r', id % 3) AS repo", "concat('/', id) AS path", "1 AS line_no", "'K' AS rule_key",
                                         "concat('f', id) AS fingerprint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        runs = report.numbered_runs(rows, 1000)
        plan = runs._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan
        assert runs.count() == 20000 and runs.select("repo", "run_no").distinct().count() == 21
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_code_flows_are_read_from_the_kinds_that_have_some(spark, monkeypatch):
    """A result that reads the report rows once writes none of them, and plans nothing of kinds without a flow."""
    from linesieve import queries
    from linesieve.plans.scan import scan
    code = "q = request.args\neval(q)\nz = q\nos.system(z)\npassword = 'hunter22secret'"
    monkeypatch.setattr(queries, "full_scan", lambda spark, sf: scan(corpus(spark, {"/a.py": code}), include_tests=True))

    def refused(rows):
        raise AssertionError("report rows are written")

    monkeypatch.setattr(queries, "written", refused)
    flows = queries.sarif_code_flows(spark, "")
    plan = flows._jdf.queryExecution().optimizedPlan().toString()
    assert "secret-detection" not in plan and "attack-chain" not in plan and "Union" in plan
    steps = {(r.rule_key.split("-")[0], r.position, r.step_line) for r in flows.collect()}
    assert {("TAINT", 1, 1), ("TAINT", 2, 2), ("FLOW", 1, 1)} <= steps, steps


def test_report_rows_come_together_before_they_are_listed(spark):
    from linesieve.plans import report
    from linesieve.plans.scan import scan
    code = "q = request.args\neval(q)\nz = q\nos.system(z)\npassword = 'hunter22secret'"
    result = scan(corpus(spark, {f"/{i}.py": code for i in range(9)}), include_tests=True).keep()
    made = report.json_report(result.kinds, result.summary(), per_part=10)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan
    assert report.report_values(made).count() == report.report_rows(result.kinds).count() > 0


def test_steps_of_paths_share_their_shuffles_and_writes(spark, monkeypatch):
    """Steps planned together read one shuffle of the hops; witnesses are written once for several steps, not for each."""
    n = 20
    nodes = spark.createDataFrame([(i, {0: "Source", n - 1: "Sink"}.get(i, "Return")) for i in range(n)], "id long, node_type string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(9, 4)], "src long, dst long")
    plain, plans, names = paths.written, [], ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")

    def watched(df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df)

    monkeypatch.setattr(paths, "written", watched)
    before = {name: spark.conf.get(name) for name in names}
    for name, value in zip(names, ("false", "-1")):
        spark.conf.set(name, value)
    try:
        row, = paths.simple_paths(nodes, edges).collect()
        grown = [plan for columns, plan in plans if "path" in columns]
        assert row.path == list(range(n)) and len(grown) == 4
        assert all(plan.count("ReusedExchange") >= 3 for plan in grown), grown
        plans.clear()
        row, = paths.witness_paths(nodes, edges).collect()
        assert row.path == list(range(n)) and sum("path" in columns for columns, _ in plans) == 4
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
