"""Report tables in the SARIF shape, and the writers."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesieve.functions.shared import written
from linesieve.functions.text import q, relative_path, report_level, report_score

ROWS_PER_RUN = 20000
#: Parts that the rows of a key are dealt to when they are joined with its few fields.
SALTS = 32
#: Rows of a few fields from which on their copies are never sent to every task.
FEW_ROWS = 10_000
# Version, schema and root mark of the format.
VERSION = "2.1.0"
SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"
ROOT_ID = "%SRCROOT%"
STEP_TYPE = "array<struct<path:string,line_no:int,text:string,step:string,nesting:int>>"
RELATED_TYPE = "array<struct<id:int,path:string,line_no:int,message:string>>"


def _step(line_no, text, kind, nesting=0):
    return (f"named_struct('path', path, 'line_no', {line_no}, 'text', {text}, 'step', {q(kind)}, "
            f"'nesting', {nesting})")


def _key(prefix, text):
    return f"concat({q(prefix)}, upper(replace({text}, ' ', '-')))"


def _mark(kind, *parts):
    """Names a result by kind, place and what was found; equal lines of two files have two marks."""
    return f"concat_ws('-', {q(kind)}, repo, path, {', '.join(parts)})"


def salted_join(rows: DataFrame, few: DataFrame, keys, spread) -> DataFrame:
    """``rows`` with the fields of their key. The rows of a key are dealt to SALTS parts by the ``spread``
    columns and each part meets a copy of the key's row, so no key fills a task.

    The few fields are written first. Planned together with the rows that they are counted from, their size is guessed from
    those rows, and from some size of the input on all rows travel and are sorted to meet them."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    few = written(few)
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    if few.count() > FEW_ROWS:
        copies = copies.hint("merge")
    return rows.withColumn("salt", salt).join(copies, [*keys, "salt"]).drop("salt")


TAINT_FLOW = f"array({_step('source.line_no', 'source.text', 'source')}, {_step('sink.line_no', 'sink.text', 'sink')})"
FLOW_FLOW = (f"concat(array({_step('source_line', "concat('Source: ', source_var, ' (', source_type, ')')", 'source')}), "
             f"transform(steps, s -> {_step('s.line_no', 's.text', 'pass-through', 1)}), "
             f"array({_step('sink_line', "concat('Sink: ', sink_type)", 'sink')}))")

# kind -> (kept rows, line, rule key, rule name, tags after "security", precision, message, snippet,
#          fingerprint, confidence, category, advice, code flow, related)
SHAPES = {
    "pattern": ("true", "line_no", "rule_id", "rule_name", "cwe", "'high'", "concat(rule_name, ': ', cwe)", "text",
                "fingerprint", "NULL", "category", "remediation", None, None),
    "taint": ("true", "sink.line_no", _key("TAINT-", "sink.sink_type"), "concat('Taint Flow to ', sink.sink_type)",
              "'taint-analysis'", "IF(confidence = 'HIGH', 'high', 'medium')", "description", "sink.text",
              _mark("taint", "source.line_no", "sink.line_no", "sink.sink_type"), "confidence", "'taint-flow'",
              "concat('Clean the data before it reaches ', sink.sink_type)", TAINT_FLOW,
              "array(named_struct('id', 1, 'path', path, 'line_no', source.line_no, 'message', "
              "concat('Taint source: ', source.variable, ' via ', source.source_type)))"),
    "secret": ("true", "line_no", _key("SECRET-", "rule_name"), "rule_name", "'secret'", "'high'",
               "concat(rule_name, ': ', description)", "redacted", _mark("secret", "line_no", "rule_name"), "'HIGH'",
               "'secret-detection'", "'Revoke it and keep the new one in a secret store.'", None, None),
    "dependency": ("true", "1", _key("DEP-", "vulnerability"), "concat('Vulnerable Dependency: ', package_name)",
                   "'dependency'", "'high'", "concat(package_name, '@', version, ': ', vulnerability)",
                   "concat(package_name, '@', version)", _mark("dep", "package_name", "vulnerability"),
                   "'HIGH'", "'dependency-vulnerability'", "advice", None, None),
    "composite": ("true", "line_no", "rule_id", "rule_name", "concat_ws(' ', 'composite-rule', cwe)", "lower(confidence)",
                  "concat(rule_name, ': ', cwe)", "text", _mark("composite", "rule_id", "line_no"),
                  "confidence", "'composite-rule'", "remediation", None, None),
    "flow": ("NOT is_sanitized", "sink_line", _key("FLOW-", "sink_type"), "concat('Data Flow to ', sink_type)",
             "concat_ws(' ', 'data-flow', cwe)", "lower(confidence)", "description", "sink_text",
             _mark("flow", "source_line", "sink_line", "sink_type"), "confidence", "'data-flow'",
             "concat('Clean the data before it reaches ', sink_type)", FLOW_FLOW, None),
    "iac": ("true", "line_no", "rule_id", "rule_name", "concat_ws(' ', 'iac', category, cwe)", "'high'",
            "concat('[', category, '] ', rule_name, ': ', cwe)", "text", _mark("iac", "rule_id", "line_no"), "'HIGH'",
            "concat('iac-', lower(category))", "remediation", None, None),
    "chain": ("true", "line_no", _key("CHAIN-", "title"), "title", "'attack-chain'", "'medium'",
              "concat(title, ' (CVSS ~', format_number(cvss, '0.0'), '): ', impact)", "scenario",
              _mark("chain", "line_no", "title"), "'MEDIUM'", "'attack-chain'", "impact", None,
              "transform(steps, s -> named_struct('id', s.n, 'path', s.path, 'line_no', s.line_no, "
              "'message', s.description))"),
}
KIND_ORDER = list(SHAPES)


def report_rows(kinds: dict) -> DataFrame:
    """All kinds in one report shape; sanitized flows are left out."""
    parts = {}
    for kind in reversed(KIND_ORDER):  # chains first: they write the taints and flows that are read here, too
        if kind not in kinds:
            continue
        (kept, line, key, name, tag, precision, message, snippet, mark, confidence, category, advice, steps,
         related) = SHAPES[kind]
        parts[kind] = kinds[kind].filter(kept).selectExpr(
            f"'{kind}' AS kind", "repo", "path", f"CAST({line} AS int) AS line_no", f"{key} AS rule_key",
            f"{name} AS rule_name", f"{tag} AS tag", f"{precision} AS precision", "severity",
            f"{message} AS message", f"{snippet} AS snippet", f"{mark} AS fingerprint",
            f"CAST({confidence} AS string) AS confidence", f"{category} AS category", f"{advice} AS advice",
            f"CAST({steps or 'array()'} AS {STEP_TYPE}) AS code_flow",
            f"CAST({related or 'array()'} AS {RELATED_TYPE}) AS related")
    return reduce(DataFrame.unionByName, reversed(parts.values()))


def sarif_rules(rows: DataFrame) -> DataFrame:
    """One descriptor per rule key and repo, numbered from 0.

    The fields come from the key's first row in place order. The keys of a repo
    are bounded by the catalogs, so numbering them needs little.
    """
    order = F.expr("array_position(array({}), kind)".format(", ".join(q(k) for k in KIND_ORDER)))
    first = rows.groupBy("repo", "kind", "rule_key").agg(F.min(F.struct(
        "path", "line_no", "severity", "rule_name", "tag", "precision", "advice")).alias("first"))
    w = Window.partitionBy("repo").orderBy(order, "rule_key")
    return first.withColumn("rule_index", (F.row_number().over(w) - 1)).selectExpr(
        "repo", "kind", "rule_key", "rule_index", "first.rule_name AS rule_name",
        f"{report_level('first.severity')} AS level", f"{report_score('first.severity')} AS security_severity",
        "first.tag AS tag", "first.precision AS precision", "first.advice AS advice")


def sarif_results(rows: DataFrame, root: str = "/") -> DataFrame:
    """One result per row with its rule index.

    The descriptors grow with the number of repos, so no broadcast is asked for:
    Spark takes one where the measured size allows it; else the rows of a rule are dealt to parts.
    """
    return with_index(rows, sarif_rules(rows)).selectExpr(
        "repo", "kind", "rule_key", "rule_index", f"{report_level('severity')} AS level", "message",
        f"{relative_path('path', root)} AS uri", "line_no", "snippet",
        "map('primaryLocationLineHash', fingerprint) AS fingerprints", "confidence", "category",
        "code_flow", "related")


def with_index(rows: DataFrame, rules: DataFrame) -> DataFrame:
    return salted_join(rows, rules.select("repo", "kind", "rule_key", "rule_index"), ["repo", "kind", "rule_key"],
                       ["path", "line_no", "fingerprint"])


def sarif_code_flows(rows: DataFrame, root: str = "/") -> DataFrame:
    """Ordered locations of every result that has a flow."""
    flows = rows.filter("size(code_flow) > 0").selectExpr(
        "repo", "path", "rule_key", "line_no", "fingerprint", "posexplode(code_flow) AS (pos, step)")
    return flows.selectExpr("repo", f"{relative_path('path', root)} AS uri", "rule_key", "line_no", "fingerprint",
                            "pos + 1 AS position", "step.line_no AS step_line", "step.text AS step_text",
                            "step.step AS step", "step.nesting AS nesting")


def sarif_related(rows: DataFrame, root: str = "/") -> DataFrame:
    related = rows.selectExpr("repo", "path", "rule_key", "line_no", "inline(related) AS (id, at_path, at_line, note)")
    return related.selectExpr("repo", f"{relative_path('path', root)} AS uri", "rule_key", "line_no", "id",
                              f"{relative_path('at_path', root)} AS related_uri", "at_line", "note")


def numbered_runs(rows: DataFrame, per_run: int = ROWS_PER_RUN) -> DataFrame:
    """``run_no``: spreads a repo's rows over runs of about ``per_run``.

    A repo with most of the rows becomes many runs, never one group.
    """
    sizes = rows.groupBy("repo").agg(F.ceil(F.count(F.lit(1)) / per_run).alias("runs"))
    return salted_join(rows, sizes, ["repo"], ["path", "line_no", "fingerprint"]).withColumn(
        "run_no", F.expr("CAST(pmod(xxhash64(path, line_no, rule_key, fingerprint), runs) AS int)")).drop("runs")


def sarif_document(rows: DataFrame, root: str = "/", tool: str = "linesieve", per_run: int = ROWS_PER_RUN) -> DataFrame:
    """One JSON document per repo and run: tool, rules, results."""
    results = numbered_runs(rows, per_run)
    index = sarif_rules(rows)
    joined = with_index(results, index)

    def place(path, line, text):
        return (f"named_struct('physicalLocation', named_struct('artifactLocation', named_struct('uri', "
                f"{relative_path(path, root)}, 'uriBaseId', {q(ROOT_ID)}), 'region', named_struct('startLine', {line}, "
                f"'startColumn', 1, 'snippet', named_struct('text', {text}))))")

    result = joined.selectExpr("repo", "run_no", (
        f"named_struct('ruleId', rule_key, 'ruleIndex', rule_index, 'level', {report_level('severity')}, "
        f"'message', named_struct('text', message), 'locations', array({place('path', 'line_no', 'snippet')}), "
        "'fingerprints', map('primaryLocationLineHash', fingerprint), 'codeFlows', IF(size(code_flow) = 0, NULL, "
        "array(named_struct('threadFlows', array(named_struct('locations', transform(code_flow, s -> named_struct("
        f"'location', {place('s.path', 's.line_no', 's.text')}, 'kinds', array(s.step), 'nestingLevel', s.nesting)"
        "))))))"
        f", 'relatedLocations', IF(size(related) = 0, NULL, transform(related, r -> named_struct('id', r.id, "
        f"'location', {place('r.path', 'r.line_no', 'r.message')}))), "
        "'properties', named_struct('confidence', confidence, 'category', category)) AS result"))
    runs = result.repartition("repo", "run_no").groupBy("repo", "run_no").agg(F.collect_list("result").alias("results"))
    descriptor = ("named_struct('id', rule_key, 'name', rule_name, 'shortDescription', named_struct('text', rule_name), "
                  "'fullDescription', named_struct('text', concat(rule_name, ' (', tag, ')')), 'help', "
                  "named_struct('text', advice), 'defaultConfiguration', named_struct('level', level), 'properties', "
                  "named_struct('tags', concat(array('security'), split(tag, ' ')), 'precision', precision, "
                  "'security-severity', security_severity))")
    rules = index.groupBy("repo").agg(F.expr(
        f"transform(array_sort(collect_list(struct(rule_index, {descriptor} AS rule))), r -> r.rule)").alias("rules"))
    return salted_join(runs, rules, ["repo"], ["run_no"]).selectExpr("repo", "run_no", (
        f"to_json(named_struct('$schema', {q(SCHEMA)}, 'version', {q(VERSION)}, 'runs', array(named_struct('tool', named_struct('driver', "
        f"named_struct('name', {q(tool)}, 'rules', rules)), 'results', results, 'invocations', "
        "array(named_struct('executionSuccessful', true)))))) AS document"))


#: The parts of the two documents that are read back.
DOCUMENT_VALUES = """runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string>>>>, results: array<struct<
    ruleId: string, ruleIndex: int, level: string, message: struct<text: string>, locations: array<struct<physicalLocation: struct<
    artifactLocation: struct<uri: string>, region: struct<startLine: int, snippet: struct<text: string>>>>>,
    fingerprints: map<string, string>, codeFlows: array<struct<threadFlows: array<struct<locations: array<struct<kinds: array<string>>>>>>>,
    relatedLocations: array<struct<id: int>>, properties: struct<confidence: string, category: string>>>>>"""
REPORT_VALUES = """summary struct<files: bigint, total_vulnerabilities: bigint, total_chains: bigint>, findings array<struct<
    kind: string, path: string, line_no: int, rule_key: string, severity: string, message: string, category: string>>"""


def document_values(documents: DataFrame) -> DataFrame:
    """The results of ``sarif_document`` read back from its JSON, with the id of the rule that each index points to."""
    runs = documents.selectExpr("repo", f"inline(from_json(document, {q(DOCUMENT_VALUES)}).runs)")
    rows = runs.selectExpr("repo", "tool.driver.rules AS rules", "explode(results) AS r")
    place = "r.locations[0].physicalLocation"
    return rows.selectExpr(
        "repo", "r.ruleId AS rule_key", "rules[r.ruleIndex].id AS indexed_rule", "r.ruleIndex AS rule_index", "r.level AS level",
        "r.message.text AS message", f"{place}.artifactLocation.uri AS uri", f"{place}.region.startLine AS line_no",
        f"{place}.region.snippet.text AS snippet", "r.fingerprints['primaryLocationLineHash'] AS line_hash",
        "coalesce(size(r.codeFlows[0].threadFlows[0].locations), 0) AS n_steps", "coalesce(size(r.relatedLocations), 0) AS n_related",
        "r.properties.confidence AS confidence", "r.properties.category AS category")


def report_values(documents: DataFrame) -> DataFrame:
    """The findings of ``json_report`` read back from its JSON, each with totals of its repo's summary."""
    parts = documents.selectExpr("repo", f"from_json(document, {q(REPORT_VALUES)}) AS d")
    return parts.selectExpr("repo", "d.summary.files AS files", "d.summary.total_vulnerabilities AS total_vulnerabilities",
                            "d.summary.total_chains AS total_chains", "inline(d.findings)")


def json_report(kinds: dict, summary: DataFrame, per_part: int = ROWS_PER_RUN) -> DataFrame:
    """One JSON document per repo and part: summary and rows of every kind.

    The rows of a part come together before they are listed: lists made where the rows are would be sorted from some
    number of parts on.
    """
    rows = numbered_runs(report_rows(kinds), per_part)
    item = ("struct(kind, path, line_no, rule_key, rule_name, severity, message, snippet, confidence, category, "
            "code_flow, related)")
    parts = rows.selectExpr("repo", "run_no", f"{item} AS item").repartition("repo", "run_no").groupBy("repo", "run_no").agg(
        F.collect_list("item").alias("findings"))
    totals = summary.selectExpr("repo", "struct(* EXCEPT (repo)) AS summary")
    return salted_join(parts, totals, ["repo"], ["run_no"]).selectExpr(
        "repo", "run_no AS part", "to_json(struct(summary, findings)) AS document")


def write_tables(kinds: dict, folder: str, fmt: str = "parquet") -> None:
    """One dataset per kind; the form for results of any size."""
    for kind, df in kinds.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{kind}")


