"""Attack chains: findings and flows correlated per file and per repo."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from linesieve.catalog.chains import (
    CHAINS, CHECKSUM_WORDS, GADGET_EXTENSIONS, PLATFORM_NOTES, TOKEN_LOG_PREFIXES)
from linesieve.functions.text import contains_any, one_of, q, starts_with_any

FILE_KEY = ["repo", "path"]
SQL_CWE = "CWE-89"


def _step(number, description, path, line_no, kind):
    return (f"named_struct('n', {number}, 'description', {q(description)}, 'path', {path}, "
            f"'line_no', {line_no}, 'type', {kind})")


def _chain(rows: DataFrame, key: str, steps: str, title: str = "", scenario: str = "''") -> DataFrame:
    name, severity, score, impact, _ = CHAINS[key]
    return rows.selectExpr(
        "repo", "path", "line_no", f"{q(key)} AS chain", f"{title or q(name)} AS title",
        f"{q(severity)} AS severity", f"CAST({score} AS double) AS cvss", f"{q(impact)} AS impact",
        f"{scenario} AS scenario", f"{steps} AS steps")


def anchor_chain(findings: DataFrame, key: str, where: str) -> DataFrame:
    """One chain per anchor finding, every step at its line."""
    steps = ", ".join(_step(n, about, "path", "line_no", q(kind))
                      for n, (about, kind) in enumerate(CHAINS[key][4], 1))
    scenario = f"concat({q(CHAINS[key][3])}, ', starting at line ', line_no, ' in ', path)"
    return _chain(findings.filter(where), key, f"array({steps})", scenario=scenario)


def companions(findings: DataFrame) -> DataFrame:
    """Per file: first path traversal, request forgery and injection finding."""
    injection = f"category = 'CommandInjection' OR cwe = {q(SQL_CWE)}"
    return findings.groupBy(*FILE_KEY).agg(
        F.expr("min(line_no) FILTER (WHERE category = 'PathTraversal')").alias("traversal_line"),
        F.expr("min(line_no) FILTER (WHERE category = 'SSRF')").alias("ssrf_line"),
        F.expr(f"min(struct(line_no, rule_id)) FILTER (WHERE {injection})").alias("injection"))


def tainted_exec(taints: DataFrame, include_sanitized: bool = False) -> DataFrame:
    rows = taints.filter("sink.sink_type IN ('sql_execution', 'command_execution')")
    if not include_sanitized:
        rows = rows.filter("NOT is_sanitized")
    label = "IF(sink.sink_type = 'sql_execution', 'SQL Injection', 'Command Injection')"
    about = [text for text, _ in CHAINS["tainted_exec"][4]]
    steps = (f"array({_step(1, about[0], 'path', 'source.line_no', q('taint_source'))}, "
             f"{_step(2, about[1], 'path', 'sink.line_no', 'sink.sink_type')})")
    return _chain(rows.withColumn("line_no", F.col("source.line_no")), "tainted_exec", steps,
                  f"concat('Taint-confirmed ', {label}, ' via ', source.source_type)",
                  "concat(source.variable, ' from line ', source.line_no, ' reaches line ', sink.line_no)")


def ssrf_internal(findings: DataFrame) -> DataFrame:
    (about, kind), (more, more_kind) = CHAINS["ssrf_internal"][4]
    rows = findings.filter("category = 'SSRF'").join(companions(findings), FILE_KEY, "left")
    steps = (f"filter(array({_step(1, about, 'path', 'line_no', q(kind))}, "
             f"{_step(2, more, 'path', 'traversal_line', q(more_kind))}), s -> s.line_no IS NOT NULL)")
    return _chain(rows, "ssrf_internal", steps, scenario="concat('Request forgery at line ', line_no, ' in ', path)")


def xxe_ssrf(findings: DataFrame) -> DataFrame:
    parts = CHAINS["xxe_ssrf"][4]
    rows = (findings.filter("category = 'XXE'").join(companions(findings), FILE_KEY)
            .filter("ssrf_line IS NOT NULL"))
    places = ["line_no", "ssrf_line", "line_no"]
    steps = ", ".join(_step(n, about, "path", places[n - 1], q(kind)) for n, (about, kind) in enumerate(parts, 1))
    return _chain(rows, "xxe_ssrf", f"array({steps})", scenario="concat('Entity parsing at line ', line_no, ' in ', path)")


def auth_escalation(findings: DataFrame) -> DataFrame:
    (a, a_kind), (b, b_kind), (c, _) = CHAINS["auth_escalation"][4]
    rows = findings.filter("category = 'BrokenAuth'").join(companions(findings), FILE_KEY, "left")
    steps = (f"filter(array({_step(1, a, 'path', 'line_no', q(a_kind))}, {_step(2, b, 'path', 'line_no', q(b_kind))}, "
             f"{_step(3, c, 'path', 'injection.line_no', 'injection.rule_id')}), s -> s.line_no IS NOT NULL)")
    return _chain(rows, "auth_escalation", steps,
                  scenario="concat('Weak authentication at line ', line_no, ' in ', path)")


def _pair_per_repo(findings: DataFrame, key: str, first: str, second: str, order) -> DataFrame:
    """One chain per repo that has both kinds; each kind's first place in (path,
    line) order. Both come from one partially aggregated pass."""
    both = findings.groupBy("repo").agg(
        F.expr(f"min(struct(path, line_no)) FILTER (WHERE {first})").alias("a"),
        F.expr(f"min(struct(path, line_no)) FILTER (WHERE {second})").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    steps = ", ".join(_step(n, about, f"{side}.path", f"{side}.line_no", q(kind))
                      for n, ((about, kind), side) in enumerate(zip(CHAINS[key][4], order), 1))
    rows = both.selectExpr("*", "a.path AS path", "a.line_no AS line_no")
    return _chain(rows, key, f"array({steps})",
                  scenario="concat(a.path, ':', a.line_no, ' and ', b.path, ':', b.line_no)")


def crypto_secret(findings: DataFrame) -> DataFrame:
    """Weak crypto that is not a checksum, and a secret, anywhere in the repo."""
    weak = f"category = 'WeakCrypto' AND NOT {contains_any('lower(text)', CHECKSUM_WORDS)}"
    return _pair_per_repo(findings, "crypto_secret", "category = 'HardcodedSecret'", weak, "ab")


def sqli_auth_repo(findings: DataFrame) -> DataFrame:
    return _pair_per_repo(findings, "sqli_auth_repo", "category = 'BrokenAuth'", f"cwe = {q(SQL_CWE)}", "abb")


def flow_sinks_of(taints: DataFrame, flows: DataFrame, kind: str) -> DataFrame:
    """Taint and flow rows that end in one sink kind, in one shape."""
    return (taints.filter(f"sink.sink_type = {q(kind)}").selectExpr(
        "repo", "path", "source.line_no AS line_no", "sink.line_no AS sink_line")
        .unionByName(flows.filter(f"sink_type = {q(kind)}").selectExpr(
            "repo", "path", "source_line AS line_no", "sink_line")).distinct())


def _sink_chain(taints, flows, key, kind) -> DataFrame:
    rows = flow_sinks_of(taints, flows, kind)
    places = ["line_no"] + ["sink_line"] * (len(CHAINS[key][4]) - 1)
    steps = ", ".join(_step(n, about, "path", places[n - 1], q(step))
                      for n, (about, step) in enumerate(CHAINS[key][4], 1))
    return _chain(rows, key, f"array({steps})",
                  scenario="concat('Input of line ', line_no, ' reaches line ', sink_line, ' in ', path)")


def log_forging(taints, flows) -> DataFrame:
    return _sink_chain(taints, flows, "log_forging", "log_injection")


def template_rce(taints, flows) -> DataFrame:
    return _sink_chain(taints, flows, "template_rce", "template_injection")


def token_in_logs(findings: DataFrame) -> DataFrame:
    where = f"category = 'InfoDisclosure' AND {starts_with_any('rule_id', TOKEN_LOG_PREFIXES)}"
    note = (f"CASE WHEN {one_of('ext', ['kt', 'java'])} THEN {q(PLATFORM_NOTES['android'])} "
            f"WHEN {one_of('ext', ['swift', 'm', 'mm'])} THEN {q(PLATFORM_NOTES['ios'])} "
            f"ELSE {q(PLATFORM_NOTES['other'])} END")
    steps = ", ".join(_step(n, about, "path", "line_no", q(kind))
                      for n, (about, kind) in enumerate(CHAINS["token_in_logs"][4], 1))
    return _chain(findings.filter(where), "token_in_logs", f"array({steps})",
                  scenario=f"concat('Token at line ', line_no, ' in ', path, ', readable in the ', {note})")


ANCHORS = {
    "xss_takeover": "category = 'XSS'",
    "deser_rce": f"category = 'InsecureDeserialization' AND {one_of('ext', GADGET_EXTENSIONS)}",
    "proto_rce": "category = 'PrototypePollution'",
    "path_creds": "category = 'PathTraversal'",
    "redirect_oauth": "category = 'OpenRedirect'",
}


def chain_parts(findings: DataFrame, taints: DataFrame, flows: DataFrame) -> dict:
    """All chain tables by key. ``findings`` are deduplicated pattern findings."""
    parts = {key: anchor_chain(findings, key, where) for key, where in ANCHORS.items()}
    return parts | {
        "tainted_exec": tainted_exec(taints), "ssrf_internal": ssrf_internal(findings),
        "crypto_secret": crypto_secret(findings), "xxe_ssrf": xxe_ssrf(findings),
        "auth_escalation": auth_escalation(findings), "log_forging": log_forging(taints, flows),
        "template_rce": template_rce(taints, flows), "sqli_auth_repo": sqli_auth_repo(findings),
        "token_in_logs": token_in_logs(findings)}


def chain_ids(chains: DataFrame) -> DataFrame:
    """Number chains inside their file in score order.

    A running number over the whole corpus would need one task to see all rows,
    so the id is the file's digest and the number in the file.
    """
    w = Window.partitionBy(*FILE_KEY).orderBy(F.desc("cvss"), "title", "line_no", "scenario")
    return chains.withColumn("chain_id", F.concat(
        F.lit("CHAIN-"), F.substring(F.sha2(F.concat_ws(":", "repo", "path"), 256), 1, 8),
        F.format_string("-%04d", F.row_number().over(w))))


def all_chains(findings: DataFrame, taints: DataFrame, flows: DataFrame) -> DataFrame:
    return chain_ids(reduce(DataFrame.unionByName, chain_parts(findings, taints, flows).values()))
