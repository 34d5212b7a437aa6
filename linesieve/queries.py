"""Registered queries: one per operator, each over whole given tables."""

from functools import cache

from pyspark.sql import functions as F

from linesieve.functions import conditions
from linesieve.functions.shared import written
from linesieve.functions.text import (
    indent_width, report_level, report_score, severity_score, version_below)
from linesieve.operators import chains as chain_ops
from linesieve.operators import (
    composite, deps, files, flow, iac, lines, paths, patterns, post, secrets, summary, taint)
from linesieve.plans import report
from linesieve.plans.scan import scan
from linesieve.sources import derived
from linesieve.sources.corpus import corpus_from_table, drop_undecodable

SMALL_BYTES = 600
FEW_LINES = 12
PATH_NODES = paths.MAX_NODES
LEAF = conditions.leaf(r"(?i)(?:request|input)")
ALL = conditions.all_of(conditions.leaf(r"(?i)(?:execute|query|eval)\s*\("), conditions.leaf(r"\+"))
ANY = conditions.any_of(conditions.leaf(r"(?i)md5"), conditions.leaf(r"(?i)token"))
NEAR = conditions.all_of(conditions.leaf(r"\("), conditions.none_near(r"(?i)(?:clean|sanitize|escape)"))
INSIDE = conditions.all_of(conditions.leaf(r"\("), conditions.inside(r"(?i)(?:class|func|def)\s"))
NOT_INSIDE = conditions.all_of(conditions.leaf(r"\("), conditions.not_inside(r"(?i)(?:class|func|def)\s"))
EVERY_LANG = " ".join(derived.EXTENSIONS)


def code(spark, sf):
    return derived.code_corpus(spark, sf)


def sources(spark, sf):
    """Source files with their lines; test files stay in, so that grades differ."""
    return files.source_lines(files.collect_files(code(spark, sf), include_tests=True))


def findings(spark, sf):
    return post.finding_dedupe(patterns.all_findings(pattern_facts(spark, sf)))


def kept_findings(spark, sf):
    """Findings that several branches of a query read: written once, so the text is read once."""
    return written(findings(spark, sf))


def pattern_facts(spark, sf):
    return patterns.pattern_facts(sources(spark, sf))


def joint_facts(spark, sf):
    return patterns.pattern_facts(sources(spark, sf), more={"held": composite.held_rules()})


def composite_facts(spark, sf):
    return composite.composite_facts(sources(spark, sf))


def taint_facts(spark, sf):
    return taint.taint_facts(sources(spark, sf))


def flow_facts(spark, sf):
    return flow.flow_facts(sources(spark, sf))


def steps_text(steps, *fields):
    parts = ", ".join(f"s.{f}" for f in fields)
    return f"array_join(transform({steps}, s -> concat_ws('|', {parts})), ' > ')"


def classify_files(spark, sf):
    return files.classify(code(spark, sf)).select("repo", "path", "ext", "kind")


def skip_dirs(spark, sf):
    return files.drop_skipped(code(spark, sf)).select("repo", "path")


def size_guard(spark, sf):
    return files.size_guard(files.classify(code(spark, sf)), SMALL_BYTES).select("path", "kind", "size")


def binary_guard(spark, sf):
    rows = derived.read_table(spark, sf, "documents").selectExpr(
        "source", "concat('/b/', doc_id, '.py') AS path",
        "IF(doc_id % 3 = 0, concat(text, chr(0)), text) AS text")
    corpus = corpus_from_table(rows, "source", "path", "text")
    return files.binary_guard(files.classify(corpus)).select("repo", "path", "size")


def utf8_guard(spark, sf):
    """Every other document gets a byte that no UTF-8 text holds."""
    raw = derived.read_table(spark, sf, "documents").selectExpr(
        "doc_id", "concat(CAST(text AS binary), IF(doc_id % 2 = 0, X'', X'FF')) AS raw")
    return drop_undecodable(raw).selectExpr("doc_id", "length(content) AS n_chars")


def lines_guard(spark, sf):
    return files.lines_guard(files.classify(code(spark, sf)), FEW_LINES).select("path", "kind")


def minified_guard(spark, sf):
    return files.drop_minified(files.classify(code(spark, sf))).select("path", "kind")


def is_test_path(spark, sf):
    return code(spark, sf).select("repo", "path", "is_test")


def drop_tests(spark, sf):
    return files.drop_tests(files.classify(code(spark, sf))).select("path", "kind")


def ext_lang(spark, sf):
    return code(spark, sf).groupBy("ext").agg(F.count(F.lit(1)).alias("files"))


def corpus_load(spark, sf):
    return derived.natural_corpus(spark, sf).select("repo", "path", "ext", "size")


def catalog_load(spark, sf):
    """Every line rule with the number of lines it meets, zero included."""
    rules = patterns.rule_table(spark).select("rule_id", "category", "severity", "cwe")
    hits = patterns.raw_matches(pattern_facts(spark, sf)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    return rules.join(hits, "rule_id", "left").fillna(0, ["hits"])


def explode_lines(spark, sf):
    return lines.explode_lines(derived.natural_corpus(spark, sf)).select("repo", "path", "line_no", "text")


def comment_mask(spark, sf):
    numbered = files.split_files(code(spark, sf))
    return lines.comment_mask(numbered).select("path", "line_no", "is_comment")


def line_count(spark, sf):
    return lines.line_count(derived.natural_corpus(spark, sf))


def context_window(spark, sf):
    return lines.context_window(sources(spark, sf)).selectExpr(
        "path", "line_no", "array_join(context_before, chr(10)) AS before", "array_join(context_after, chr(10)) AS after")


def indent(spark, sf):
    return lines.explode_lines(code(spark, sf)).selectExpr("path", "line_no", f"{indent_width('text')} AS indent")


def scope(spark, sf):
    return taint.sink_scopes(sources(spark, sf)).drop("repo")


def pattern_scan(spark, sf):
    return findings(spark, sf).select("repo", "path", "line_no", "rule_id", "rule_name", "category", "severity",
                                      "cwe", "matched_text", "confidence")


def language_gate(spark, sf):
    hits = patterns.raw_matches(pattern_facts(spark, sf))
    return hits.groupBy("ext", "rule_id").agg(F.count(F.lit(1)).alias("hits"))


def comment_gate(spark, sf):
    return patterns.raw_matches(pattern_facts(spark, sf)).select("path", "line_no", "rule_id", "matched_text")


def use_after_free(spark, sf):
    hits = patterns.raw_matches(pattern_facts(spark, sf)).filter("rule_id = 'C-UAF-001'")
    return patterns.use_after_free(hits).select("path", "line_no", "matched_text")


def alloc_null_check(spark, sf):
    hits = patterns.raw_matches(pattern_facts(spark, sf)).filter("rule_id = 'C-MEM-002'")
    return patterns.alloc_null_check(hits).select("path", "line_no", "matched_text")


def defensive_code(spark, sf):
    return patterns.defensive_code(patterns.raw_matches(pattern_facts(spark, sf))).select("path", "line_no", "rule_id")


def fingerprints(spark, sf):
    return findings(spark, sf).select("rule_id", "path", "line_no", "fingerprint")


def path_confidence(spark, sf):
    return findings(spark, sf).groupBy("confidence").agg(F.count(F.lit(1)).alias("findings"))


def severity_scores(spark, sf):
    return findings(spark, sf).selectExpr("severity", f"{severity_score('severity')} AS score") \
        .groupBy("severity", "score").agg(F.count(F.lit(1)).alias("findings"))


def double_free(spark, sf):
    return patterns.double_free(pattern_facts(spark, sf)).select("path", "line_no", "pointer", "rule_id")


def condition_query(cond):
    def run(spark, sf):
        rules = [(EVERY_LANG, ("R", cond))]
        facts = composite.composite_facts(sources(spark, sf), rules)
        return composite.condition_hits(facts).select("path", "line_no")
    return run


def composite_scan(spark, sf):
    return composite.composite_scan(composite_facts(spark, sf)).select(
        "repo", "path", "line_no", "rule_id", "rule_name", "category", "severity", "cwe", "owasp", "confidence")


def condition_compile(spark, sf):
    table = composite.composite_table(spark).select("rule_id", "category", "confidence")
    hits = composite.condition_hits(composite_facts(spark, sf)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    return table.join(hits, "rule_id", "left").fillna(0, ["hits"])


def taint_sources(spark, sf):
    return taint.taint_sources(sources(spark, sf)).select("path", "line_no", "variable", "source_type")


def false_source_filter(spark, sf):
    """Lines that are no source whatever they look like."""
    rows = lines.numbered("lines", taint.is_false_source("lines", "s.line_no", "s.text"))
    return sources(spark, sf).selectExpr("path", f"inline({rows})").select("path", "line_no")


def taint_sinks(spark, sf):
    return taint.taint_sinks(sources(spark, sf)).select("path", "line_no", "sink_type", "severity")


def source_sink_join(spark, sf):
    return taint.tainted_pairs(taint_facts(spark, sf)).selectExpr(
        "path", "source.variable AS variable", "source.line_no AS source_line", "source.source_type AS source_type",
        "sink.line_no AS sink_line", "sink.sink_type AS sink_type")


def safe_call_filter(spark, sf):
    """Command calls per file that stay after the safe ones are dropped."""
    return taint.taint_sinks(sources(spark, sf)).filter("sink_type = 'command_execution'").select("path", "line_no")


def sanitized_between(spark, sf):
    return taint.taint_findings(taint_facts(spark, sf)).selectExpr(
        "path", "source.line_no AS source_line", "source.variable AS variable", "sink.line_no AS sink_line",
        "sink.sink_type AS sink_type", "is_sanitized", "coalesce(sanitizer_info, '') AS sanitizer_info")


def sink_scope(spark, sf):
    return taint.tainted_pairs(taint_facts(spark, sf)).selectExpr(
        "path", "sink.line_no AS sink_line", "in_test_scope").distinct()


def taint_grade(spark, sf):
    return taint.taint_findings(taint_facts(spark, sf)).selectExpr(
        "path", "source.line_no AS source_line", "source.variable AS variable", "sink.line_no AS sink_line",
        "sink.sink_type AS sink_type", "severity", "confidence", "in_test")


def taint_rows(spark, sf):
    return taint.taint_findings(taint_facts(spark, sf)).selectExpr(
        "repo", "path", "source.text AS source_text", "sink.text AS sink_text", "description")


def flow_sources(spark, sf):
    return flow.flow_sources(sources(spark, sf)).select("path", "line_no", "variable", "source_type")


def assignments(spark, sf):
    return flow.assignments(sources(spark, sf)).select("path", "line_no", "variable", "side")


def propagate(spark, sf):
    return flow.propagate(flow_facts(spark, sf)).select("path", "line_no", "variable", "root_line", "root", "source_type")


def flow_sinks(spark, sf):
    return flow.flow_sinks(sources(spark, sf)).select("path", "line_no", "sink_type", "severity", "cwe")


FLOW_FIELDS = ["path", "sink.line_no AS sink_line", "sink.sink_type AS sink_type", "from_line", "variable",
               "root_line", "root", "source_type"]


def direct_flow(spark, sf):
    return flow.direct_flow(flow_facts(spark, sf)).selectExpr(*FLOW_FIELDS)


def propagated_flow(spark, sf):
    return flow.propagated_flow(flow_facts(spark, sf)).selectExpr(*FLOW_FIELDS)


def flow_sanitized(spark, sf):
    return flow.flow_pairs(flow_facts(spark, sf)).selectExpr(*FLOW_FIELDS, "hops", "is_sanitized")


def flow_grade(spark, sf):
    return flow.flow_paths(flow_facts(spark, sf)).select(
        "path", "sink_line", "sink_type", "source_line", "source_var", "from_line", "variable", "severity",
        "confidence", "cwe", "description")


def flow_steps(spark, sf):
    return flow.flow_paths(flow_facts(spark, sf)).selectExpr(
        "path", "sink_line", "sink_type", "source_line", "from_line", "variable", "hops",
        f"{steps_text('steps', 'line_no', 'step', 'variable')} AS steps")


def flow_id(spark, sf):
    return flow.flow_paths(flow_facts(spark, sf)).select("path", "flow_id", "sink_line", "sink_type", "from_line", "variable")


def source_to_sink_paths(spark, sf):
    return paths.simple_paths(derived.flow_nodes(spark, sf), derived.flow_edges(spark, sf), PATH_NODES).selectExpr(
        "source_id", "sink_id", "array_join(transform(path, n -> CAST(n AS string)), '>') AS path", "length",
        "is_sanitized")


def witness_paths(spark, sf):
    return paths.witness_paths(derived.flow_nodes(spark, sf), derived.flow_edges(spark, sf), PATH_NODES).selectExpr(
        "source_id", "sink_id", "array_join(transform(path, n -> CAST(n AS string)), '>') AS path", "length")


def file_pattern(spark, sf):
    return iac.rule_files(derived.iac_corpus(spark, sf)).selectExpr("path", "size(rule_sets) AS rule_sets")


def iac_line_rules(spark, sf):
    return iac.iac_line_rules(derived.iac_corpus(spark, sf)).drop("remediation")


def absence_rules(spark, sf):
    return iac.absence_rules(derived.iac_corpus(spark, sf)).drop("remediation")


def manifest_route(spark, sf):
    return deps.manifest_route(derived.manifest_corpus(spark, sf)).select("path", "extractor", "ecosystem")


def manifest_deps(spark, sf):
    return deps.manifest_deps(derived.manifest_corpus(spark, sf)).select("path", "ecosystem", "package", "version")


def advisory_match(spark, sf):
    return deps.advisory_match(deps.manifest_deps(derived.manifest_corpus(spark, sf)))


def version_compare(spark, sf):
    """Every distinct package version against the advisories of its ecosystem."""
    found = deps.manifest_deps(derived.manifest_corpus(spark, sf)).select("ecosystem", "version").distinct()
    rows = found.join(F.broadcast(deps.advisory_table(spark)), "ecosystem")
    return rows.selectExpr("ecosystem", "version", "affected_below",
                           f"{version_below('version', 'affected_below')} AS below").distinct()


def risky_dep_lines(spark, sf):
    return deps.risky_dep_lines(derived.manifest_corpus(spark, sf)).select(
        "path", "package_name", "vulnerability", "severity")


def dep_group(spark, sf):
    return deps.dep_group(deps.dep_findings(derived.manifest_corpus(spark, sf)))


def secret_rows(spark, sf):
    return secrets.redact(secrets.secret_scan(derived.natural_corpus(spark, sf)))


def code_secrets(spark, sf):
    """Secrets of every source and config file of the code corpus."""
    kept = files.collect_files(code(spark, sf), include_tests=True)
    config = secrets.secret_scan(kept.filter("kind = 'Config'"))
    return secrets.secrets_of(secrets.secret_facts(files.source_lines(kept))).unionByName(config)


def secret_scan(spark, sf):
    return secret_rows(spark, sf).select("repo", "path", "line_no", "rule_name", "severity").unionByName(
        code_secrets(spark, sf).select("repo", "path", "line_no", "rule_name", "severity"))


def redact(spark, sf):
    return secret_rows(spark, sf).select("path", "line_no", "rule_name", "redacted")


def secret_dedupe(spark, sf):
    twice = secret_rows(spark, sf).unionByName(secret_rows(spark, sf))
    return secrets.secret_dedupe(twice).select("rule_name", "path", "line_no")


def secret_groups(spark, sf):
    rows = secrets.secret_scan(derived.natural_corpus(spark, sf)).unionByName(code_secrets(spark, sf))
    return secrets.secret_groups(rows)


def finding_dedupe(spark, sf):
    twice = patterns.pattern_scan(pattern_facts(spark, sf))
    return post.finding_dedupe(twice.unionByName(twice)).select("rule_id", "path", "line_no", "matched_text")


def cross_engine(spark, sf):
    """Both engines look at a file in one pass, and the difference is taken inside its row."""
    return post.finding_dedupe(patterns.uncovered_findings(joint_facts(spark, sf)))


def cross_engine_anti(spark, sf):
    return cross_engine(spark, sf).select("rule_id", "path", "line_no")


def severity_sort(spark, sf):
    return post.severity_sort(cross_engine(spark, sf)).select("score", "path", "line_no", "rule_id")


def min_severity(spark, sf):
    return post.min_severity(findings(spark, sf), "HIGH").select("rule_id", "path", "line_no", "severity")


def result_caps(spark, sf):
    return post.result_caps(findings(spark, sf), 100).select("score", "path", "line_no", "rule_id")


def rule_groups(spark, sf):
    return post.rule_groups(kept_findings(spark, sf))


def full_scan(spark, sf):
    return scan(code(spark, sf), include_tests=True, iac_files=derived.iac_corpus(spark, sf))


def all_findings(spark, sf):
    result = full_scan(spark, sf)
    return post.all_findings(result.found).groupBy("kind", "rule_key", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.min("path").alias("first_path"))


def top_lists(spark, sf):
    return post.top_lists({
        "taint": taint.taint_findings(taint_facts(spark, sf)), "flow": flow.flow_paths(flow_facts(spark, sf)),
        "iac": iac.iac_findings(derived.iac_corpus(spark, sf))})


def scan_summary(spark, sf):
    return full_scan(spark, sf).summary()


def total_issues(spark, sf):
    return summary.total_issues(full_scan(spark, sf).summary())


def sanitized_split(spark, sf):
    return summary.sanitized_split(flow.flow_paths(flow_facts(spark, sf)))


def risk_label(spark, sf):
    return summary.risk_label(full_scan(spark, sf).summary())


def gate(spark, sf):
    return summary.gate(full_scan(spark, sf).summary())


def findings_by_file(spark, sf):
    return summary.findings_by_file(findings(spark, sf))


def chain_view(df):
    return df.selectExpr("repo", "path", "line_no", "title", "severity", "cvss",
                         f"{steps_text('steps', 'n', 'path', 'line_no', 'type')} AS steps")


def finding_chain(key):
    """A chain that needs pattern findings only."""
    def run(spark, sf):
        if key in chain_ops.ANCHORS:
            return chain_view(chain_ops.anchor_chain(findings(spark, sf), key, chain_ops.ANCHORS[key]))
        return chain_view(getattr(chain_ops, key)(kept_findings(spark, sf)))
    return run


def tainted_exec(spark, sf):
    return chain_view(chain_ops.tainted_exec(taint.taint_findings(taint_facts(spark, sf))))


def sink_chain(key):
    def run(spark, sf):
        taints = taint.taint_findings(taint_facts(spark, sf))
        return chain_view(getattr(chain_ops, key)(taints, flow.flow_paths(flow_facts(spark, sf))))
    return run


def report_rows(spark, sf):
    """All kinds' report rows, for a result that reads them once."""
    return report.report_rows(full_scan(spark, sf).kinds)


def report_table(spark, sf):
    """The same, written, for a result that reads them more than once."""
    return written(report_rows(spark, sf))


def json_report(spark, sf):
    result = full_scan(spark, sf).keep()
    return report.json_report(result.kinds, result.summary())


def sarif_rules(spark, sf):
    return report.sarif_rules(report_table(spark, sf)).drop("advice")


def sarif_results(spark, sf):
    return report.sarif_results(report_table(spark, sf)).selectExpr(
        "repo", "kind", "rule_key", "rule_index", "level", "uri", "line_no",
        "fingerprints['primaryLocationLineHash'] AS line_hash", "category", "confidence")


def sarif_code_flows(spark, sf):
    return report.sarif_code_flows(report_rows(spark, sf)).select(
        "uri", "rule_key", "line_no", "fingerprint", "position", "step_line", "step", "nesting")


def sarif_related(spark, sf):
    return report.sarif_related(report_rows(spark, sf)).select("uri", "rule_key", "line_no", "id", "related_uri", "at_line")


def sarif_document(spark, sf):
    return report.sarif_document(report_table(spark, sf))


def sarif_messages(spark, sf):
    """Texts of every result; a chain's scenario is told by its rows already."""
    return report.sarif_results(report_table(spark, sf)).selectExpr(
        "repo", "kind", "rule_key", "uri", "line_no", "message", "IF(kind = 'chain', '', snippet) AS snippet",
        "size(code_flow) AS n_steps", "size(related) AS n_related")


def sarif_step_texts(spark, sf):
    return report.sarif_code_flows(report_rows(spark, sf)).select("uri", "rule_key", "line_no", "position", "step_text")


def sarif_document_values(spark, sf):
    """The documents' results, read back."""
    values = report.document_values(report.sarif_document(report_table(spark, sf)))
    return values.withColumn("snippet", F.when(F.col("category") == "attack-chain", "").otherwise(F.col("snippet")))


def json_report_values(spark, sf):
    """The documents' findings, read back."""
    return report.report_values(json_report(spark, sf))


def level_map(spark, sf):
    return findings(spark, sf).selectExpr("severity", f"{report_level('severity')} AS level",
                                          f"{report_score('severity')} AS score") \
        .groupBy("severity", "level", "score").agg(F.count(F.lit(1)).alias("findings"))


def relative_paths(spark, sf):
    from linesieve.functions.text import relative_path
    return code(spark, sf).selectExpr("path", f"{relative_path('path', '/src')} AS uri")


@cache
def registry() -> dict:
    named = [
        corpus_load, classify_files, skip_dirs, size_guard, binary_guard, utf8_guard, lines_guard, minified_guard,
        is_test_path, drop_tests, ext_lang, catalog_load, explode_lines, comment_mask, line_count, context_window,
        indent, scope, pattern_scan, language_gate, comment_gate, use_after_free, alloc_null_check, defensive_code,
        fingerprints, path_confidence, severity_scores, double_free, composite_scan, condition_compile, taint_sources,
        false_source_filter, taint_sinks, source_sink_join, safe_call_filter, sanitized_between, sink_scope,
        taint_grade, taint_rows, flow_sources, assignments, propagate, flow_sinks, direct_flow, propagated_flow,
        flow_sanitized, flow_grade, flow_steps, flow_id, source_to_sink_paths, witness_paths, file_pattern, iac_line_rules,
        absence_rules, manifest_route, manifest_deps, advisory_match, version_compare, risky_dep_lines, dep_group,
        secret_scan, redact, secret_dedupe, secret_groups, finding_dedupe, cross_engine_anti, severity_sort,
        min_severity, result_caps, rule_groups, all_findings, top_lists, scan_summary, total_issues, sanitized_split,
        risk_label, gate, findings_by_file, tainted_exec, json_report, sarif_rules, sarif_results, sarif_code_flows,
        sarif_related, sarif_document, sarif_messages, sarif_step_texts, sarif_document_values, json_report_values, level_map, relative_paths]
    out = {f.__name__: f for f in named}
    out |= {f"condition_{name}": condition_query(c) for name, c in {
        "leaf": LEAF, "all_of": ALL, "any_of": ANY, "none_near": NEAR, "inside": INSIDE,
        "not_inside": NOT_INSIDE}.items()}
    out |= {key: finding_chain(key) for key in [
        *chain_ops.ANCHORS, "ssrf_internal", "crypto_secret", "xxe_ssrf", "auth_escalation", "sqli_auth_repo",
        "token_in_logs"]}
    out |= {key: sink_chain(key) for key in ("log_forging", "template_rce")}
    return out
