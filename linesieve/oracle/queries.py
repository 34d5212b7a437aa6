"""DuckDB SQL for the registered queries."""

from functools import cache

from linesieve.catalog import advisories as adv
from linesieve.catalog import chains as ch
from linesieve.catalog import files as fixed
from linesieve.catalog import flows
from linesieve.catalog.composite import COMPOSITE_RULES
from linesieve.catalog.iac import FILE_RULES, LINE_RULES
from linesieve.catalog.rules import RULES
from linesieve.catalog.secrets import HIDDEN_ONLY, REDACT_KEEP, REDACT_WHOLE, SECRET_RULES
from linesieve.operators.patterns import ASSIGNED_POINTER, FREE_CALL, FREED_POINTER
from linesieve.oracle.base import (
    CODE, COMMENTS, HEADS, IAC, MANIFESTS, NATURAL, SOURCES, case_of, ends, false_source, ABOVE, file_columns, has,
    indent, inn, kind, lang_case, lines_list, q, rx, rxg, score, sinks_cte, skipped, sources_cte, starts, trim, with_)
from linesieve.sources import derived

KEY = "PARTITION BY repo, path ORDER BY line_no"


# -- pattern findings --------------------------------------------------------

def _rule_hits():
    def build(entries):
        merged = {}
        for rule_id, p in entries:
            merged.setdefault(rule_id, []).append(p)
        return "[" + ", ".join("CASE " + " ".join(
            f"WHEN {rx('text', p)} THEN {{'rule_id': {q(r)}, 'matched_text': {rxg('text', p)}}}" for p in ps) + " END"
            for r, ps in merged.items()) + "]"
    table = [(r[4], (r[0], r[6])) for r in RULES if r[6]]
    return lang_case(table, build, "[]")


RAW = f"""
    raw AS (SELECT repo, path, ext, is_test, line_no, text, h.rule_id AS rule_id, h.matched_text AS matched_text
      FROM (SELECT *, unnest(list_filter({_rule_hits()}, lambda x: x IS NOT NULL)) AS h FROM masked
      WHERE NOT is_comment))"""

_BODY = trim("l.text")
_NAMED = "contains(l.body, f.pointer)"
FREED = f"""
    frees AS (SELECT repo, path, line_no, {rxg('text', FREE_CALL, 1)} AS pointer,
      length(text) - length(ltrim(text, ' ' || chr(9) || chr(11) || chr(12))) AS depth FROM raw WHERE rule_id = 'C-UAF-001'),
    bodies AS (SELECT repo, path, line_no, text, {trim('text')} AS body FROM lines WHERE {trim('text')} <> ''),
    after_free AS (SELECT f.repo, f.path, f.line_no, l.line_no AS at_no, CASE
        WHEN (l.body = '}}' OR {starts('l.body', fixed.SCOPE_END_STARTS)}) AND length(l.text) - length(l.body) <= f.depth THEN 'end'
        WHEN {_NAMED} AND {has('l.body', fixed.NULLIFY_MARKS)} THEN 'null'
        WHEN {_NAMED} AND NOT {starts('l.body', ['//', '/*'])} THEN 'use' END AS verdict
      FROM frees f JOIN bodies l ON l.repo = f.repo AND l.path = f.path AND l.line_no > f.line_no),
    used AS (SELECT repo, path, line_no FROM after_free WHERE verdict IS NOT NULL GROUP BY ALL
      HAVING arg_min(verdict, at_no) = 'use'),
    null_tests AS (SELECT repo, path, line_no FROM lines WHERE {has(f"lower({trim('text')})", fixed.NULL_TEST_MARKS)}),
    tested AS (SELECT DISTINCT r.repo, r.path, r.line_no FROM raw r JOIN null_tests n ON n.repo = r.repo
      AND n.path = r.path AND n.line_no BETWEEN r.line_no + 1 AND r.line_no + 3 WHERE r.rule_id = 'C-MEM-002')"""

_DEFENSIVE = f"({inn('rule_id', fixed.DEFENSIVE_RULES)} AND {has('lower(text)', fixed.DEFENSIVE_WORDS)})"
_UAF = "(rule_id <> 'C-UAF-001' OR EXISTS (SELECT 1 FROM used u WHERE u.repo = raw.repo AND u.path = raw.path AND u.line_no = raw.line_no))"
_ALLOC = "(rule_id <> 'C-MEM-002' OR NOT EXISTS (SELECT 1 FROM tested u WHERE u.repo = raw.repo AND u.path = raw.path AND u.line_no = raw.line_no))"
_FREED_COL, _SET_COL = rxg("text", FREED_POINTER, 1), rxg("text", ASSIGNED_POINTER, 1)
DOUBLE = f"""
    pointer_events AS (SELECT repo, path, ext, is_test, line_no, text, {_FREED_COL} <> '' AS frees,
      coalesce(nullif({_FREED_COL}, ''), nullif({_SET_COL}, '')) AS pointer FROM lines
      WHERE ext IN ('c', 'cpp') AND NOT {starts(trim('text'), fixed.COMMENT_STARTS)}),
    doubled AS (SELECT * FROM (SELECT *, lag(frees) OVER (PARTITION BY repo, path, pointer ORDER BY line_no) AS before
      FROM pointer_events WHERE pointer IS NOT NULL) WHERE frees AND before)"""

_META = "(VALUES " + ", ".join(
    f"({q(r[0])}, {q(r[1])}, {q(r[2])}, {q(r[3])}, {q(r[5])})" for r in {x[0]: x for x in reversed(RULES)}.values()
) + ") AS m(rule_id, rule_name, category, severity, cwe)"
FOUND = f"""
    kept AS (SELECT repo, path, ext, is_test, line_no, text, rule_id, matched_text FROM raw
      WHERE {_UAF} AND {_ALLOC} AND NOT {_DEFENSIVE}
      UNION ALL SELECT repo, path, ext, is_test, line_no, text, 'C-MEM-001', {rxg('text', FREED_POINTER)} FROM doubled),
    findings AS (SELECT k.*, m.rule_name, m.category, m.severity, m.cwe,
      CASE WHEN is_test THEN 'LOW' ELSE 'HIGH' END AS confidence FROM kept k JOIN {_META} USING (rule_id))"""
PATTERNS = [CODE, SOURCES, COMMENTS, RAW, FREED, DOUBLE, FOUND]


# -- composite ----------------------------------------------------------------

def _cond_columns(cond, acc):
    """Line flags for every pattern of a tree, keyed by pattern."""
    for p in cond.patterns():
        acc.setdefault(p, f"f{len(acc)}")
    return acc


def _cond_sql(cond, names, need):
    if cond.kind == "leaf":
        return names[cond.pattern]
    if cond.kind in ("all_of", "any_of"):
        word = " AND " if cond.kind == "all_of" else " OR "
        return "(" + word.join(_cond_sql(c, names, need) for c in cond.children) + ")"
    if cond.kind == "none_near":
        col = names[cond.children[0].pattern]
        need.add(("near", col))
        return f"(NOT {col}_near)"
    col = names[cond.pattern]
    need.add(("in", col))
    hit = f"coalesce({col}_last >= coalesce(far_blank, 0), false)"
    return hit if cond.kind == "inside" else f"(NOT {hit})"


def _conditions(rules, name):
    """rules: (languages, rule id, condition)."""
    names, need = {}, set()
    for _, _, c in rules:
        _cond_columns(c, names)
    tests = [(langs, rule_id, _cond_sql(c, names, need)) for langs, rule_id, c in rules]
    flags = ", ".join(f"{rx('text', p)} AS {n}" for p, n in names.items())
    wins = [f"bool_or({c}) OVER ({KEY} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS {c}_near" if k == "near" else
            f"max(CASE WHEN {c} THEN line_no END) OVER ({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {c}_last"
            for k, c in sorted(need)]
    wins.append(f"max(CASE WHEN blank THEN line_no END) OVER ({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING) AS far_blank")
    hits = ", ".join(f"CASE WHEN {inn('ext', langs.split())} AND {t} THEN {q(r)} END" for langs, r, t in tests)
    return f"""
    {name}_flags AS (SELECT repo, path, ext, is_test, line_no, text, {trim('text')} = '' AS blank, {flags} FROM lines),
    {name}_wins AS (SELECT *, {', '.join(wins)} FROM {name}_flags),
    {name}_hits AS (SELECT repo, path, ext, line_no, text, unnest(list_filter([{hits}], lambda x: x IS NOT NULL)) AS rule_id
      FROM {name}_wins)"""


_COMP_META = "(VALUES " + ", ".join(
    f"({q(r[0])}, {q(r[1])}, {q(r[2])}, {q(r[3])}, {q(r[4])}, {q(r[6])}, {q(r[7])})" for r in COMPOSITE_RULES
) + ") AS m(rule_id, rule_name, severity, cwe, owasp, category, confidence)"
COMPOSITE = _conditions([(r[5], r[0], r[8]) for r in COMPOSITE_RULES], "comp") + f""",
    composites AS (SELECT h.*, m.rule_name, m.severity, m.cwe, m.owasp, m.category, m.confidence
      FROM comp_hits h JOIN {_COMP_META} USING (rule_id))"""


# -- taint ----------------------------------------------------------------------

_SAN = []
for _, words, langs, pattern in flows.SANITIZERS:
    for sink in flows.TAINT_SINKS:
        if any(w in sink[0] for w in words.split()):
            _SAN.append(f"({q(sink[0])}, {inn('ext', langs.split())} AND {rx('text', pattern)})")
_SAN_ROWS = " UNION ALL ".join(
    f"SELECT repo, path, line_no, text, {q(sink[0])} AS sink_type FROM lines WHERE {inn('ext', langs.split())} AND {rx('text', pattern)}"
    for _, words, langs, pattern in flows.SANITIZERS for sink in flows.TAINT_SINKS if any(w in sink[0] for w in words.split()))
TAINT = ",".join([
    sources_cte("tsrc", flows.TAINT_SOURCES),
    sinks_cte("tsink", [(k, langs, sev, "", p) for k, langs, sev, p in flows.TAINT_SINKS]),
    HEADS, f"""
    san AS ({_SAN_ROWS}),
    tpairs AS (SELECT s.repo, s.path, s.ext, s.is_test, s.variable, s.source_type, s.line_no AS source_line,
        s.text AS source_text, k.line_no AS sink_line, k.text AS sink_text, k.sink_type, k.sink_severity
      FROM tsrc s JOIN tsink k ON k.repo = s.repo AND k.path = s.path AND k.line_no > s.line_no
      AND contains(k.text, s.variable)),
    tsan AS (SELECT p.repo, p.path, p.source_line, p.sink_line, p.sink_type, arg_min(z.text, z.line_no) AS san_text,
        min(z.line_no) AS san_line FROM tpairs p JOIN san z ON z.repo = p.repo AND z.path = p.path
      AND z.sink_type = p.sink_type AND z.line_no > p.source_line AND z.line_no <= p.sink_line GROUP BY ALL),
    tscope AS (SELECT m.repo, m.path, m.line_no, arg_max(h.is_test, h.line_no) AS in_test_scope
      FROM measured m JOIN fn_heads h ON h.repo = m.repo AND h.path = m.path AND h.line_no <= m.line_no
      AND (h.indent <= m.indent OR h.indent = 0) GROUP BY ALL),
    taints AS (SELECT p.*, s.san_line IS NOT NULL AS is_sanitized,
        coalesce('Sanitizer at line ' || s.san_line || ': ' || {trim('s.san_text')}, '') AS sanitizer_info,
        coalesce(c.in_test_scope, false) AS in_test_scope, p.is_test OR coalesce(c.in_test_scope, false) AS in_test
      FROM tpairs p LEFT JOIN tsan s ON s.repo = p.repo AND s.path = p.path AND s.source_line = p.source_line
        AND s.sink_line = p.sink_line AND s.sink_type = p.sink_type
      LEFT JOIN tscope c ON c.repo = p.repo AND c.path = p.path AND c.line_no = p.sink_line),
    tgraded AS (SELECT *, CASE WHEN in_test OR is_sanitized THEN 'LOW' WHEN sink_line - source_line < 20 THEN 'HIGH'
        ELSE 'MEDIUM' END AS confidence, CASE WHEN is_sanitized THEN 'LOW' WHEN in_test THEN 'INFO' ELSE sink_severity
        END AS severity, variable || ', set by ' || source_type || ' in line ' || source_line || ', is used by ' || sink_type
        || ' in line ' || sink_line || CASE WHEN is_sanitized THEN ', cleaned between' ELSE '' END
        AS description FROM taints)"""])


# -- flow -----------------------------------------------------------------------

def _form(p):
    return (f"CASE WHEN {rx('text', p)} THEN {{'variable': {rxg('text', p, 1)}, 'side': {rxg('text', p, 2)}}} END")


FLOW_BASE = ",".join([
    sources_cte("fsrc", flows.FLOW_SOURCES), sinks_cte("fsink", flows.FLOW_SINKS), f"""
    assigns AS (SELECT DISTINCT repo, path, line_no, a.variable AS variable, a.side AS side FROM (SELECT *,
      unnest(list_filter([{_form(flows.DECLARATION)}, {_form(flows.ASSIGNMENT)}], lambda x: x IS NOT NULL)) AS a FROM lines))"""])

# Lines are taken in order: step n of a file handles its n-th assignment line
# and appends to the list of variables known so far.
FLOW = FLOW_BASE + """,
    a_lines AS (SELECT repo, path, line_no, list({'variable': variable, 'side': side}) AS forms,
      row_number() OVER (PARTITION BY repo, path ORDER BY line_no) AS n FROM assigns
      WHERE (repo, path) IN (SELECT repo, path FROM fsrc) GROUP BY repo, path, line_no),
    f_lists AS (SELECT repo, path, list({'variable': variable, 'line_no': line_no, 'source_type': source_type}) AS srcs
      FROM fsrc GROUP BY repo, path),
    grow(repo, path, srcs, n, known) AS (
      SELECT repo, path, srcs, 0::BIGINT, []::STRUCT(line_no BIGINT, variable VARCHAR, root_line BIGINT, root VARCHAR,
        source_type VARCHAR)[] FROM f_lists
      UNION ALL
      SELECT g.repo, g.path, g.srcs, a.n, list_concat(g.known, flatten(list_transform(a.forms, lambda f: list_concat(
        list_transform(list_filter(g.srcs, lambda s: s.line_no < a.line_no AND contains(f.side, s.variable)),
          lambda s: struct_pack(line_no := a.line_no::BIGINT, variable := f.variable, root_line := s.line_no::BIGINT,
            root := s.variable, source_type := s.source_type)),
        list_transform(list_slice(list_sort(list_filter(g.known, lambda p: p.line_no < a.line_no
            AND contains(f.side, p.variable))), 1, 1),
          lambda p: struct_pack(line_no := a.line_no::BIGINT, variable := f.variable, root_line := p.root_line,
            root := p.root, source_type := p.source_type))))))
      FROM grow g JOIN a_lines a ON a.repo = g.repo AND a.path = g.path AND a.n = g.n + 1),
    derived AS (SELECT DISTINCT repo, path, d.line_no AS line_no, d.variable AS variable, d.root_line AS root_line,
      d.root AS root, d.source_type AS source_type FROM (SELECT repo, path, unnest(arg_max(known, n)) AS d FROM grow
      GROUP BY repo, path)),
    reach AS (SELECT repo, path, 0 AS hops, line_no AS from_line, variable, line_no AS root_line, variable AS root,
        source_type FROM fsrc
      UNION ALL SELECT repo, path, 1, line_no, variable, root_line, root, source_type FROM derived),
    fpairs AS (SELECT k.repo, k.path, k.ext, k.is_test, k.line_no AS sink_line, k.text AS sink_text, k.sink_type,
        k.sink_severity, k.cwe, k.rank, r.hops, r.from_line, r.variable, r.root_line, r.root, r.source_type
      FROM fsink k JOIN reach r ON r.repo = k.repo AND r.path = k.path AND r.from_line < k.line_no
      AND contains(k.text, r.variable)),
    fsan AS (SELECT repo, path, line_no, text FROM lines WHERE """ + rx("text", flows.VALIDATE_CALL) + " OR " + " OR ".join(
    f"({inn('ext', langs.split())} AND {rx('text', p)})" for _, langs, p in flows.FLOW_SANITIZERS) + f"""),
    flows AS (SELECT p.*, EXISTS (SELECT 1 FROM fsan z WHERE z.repo = p.repo AND z.path = p.path
        AND z.line_no > p.from_line AND z.line_no <= p.sink_line AND contains(z.text, p.variable)) AS is_sanitized,
        {inn('p.source_type', flows.LOCAL_SOURCE_TYPES)} AS is_local FROM fpairs p),
    fgraded AS (SELECT *, CASE WHEN is_sanitized OR is_test OR is_local THEN 'LOW'
        WHEN sink_line - root_line < CASE WHEN hops = 0 THEN 15 ELSE 20 END THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
        CASE WHEN is_sanitized THEN 'LOW' WHEN is_test THEN 'INFO' WHEN is_local THEN 'LOW' ELSE sink_severity END AS severity,
        source_type || ' in line ' || root_line || ' reaches ' || sink_type || ' in line ' || sink_line
          || CASE WHEN hops = 0 THEN '' ELSE ' as ' || variable || ', taken from ' || root || ' in line ' || from_line END
          || CASE WHEN is_sanitized THEN ', cleaned on the way' ELSE ', not cleaned' END
        AS description, 'FLOW-' || lpad(row_number() OVER (PARTITION BY repo, path ORDER BY sink_line, rank, hops, from_line,
        variable, root_line, root, source_type)::VARCHAR, 4, '0') AS flow_id FROM flows)"""
TAINTED = [CODE, SOURCES, TAINT]
FLOWING = [CODE, SOURCES, FLOW]


# -- config, dependencies, secrets -----------------------------------------------

def _file_test(path_low, names):
    return "(" + " OR ".join(f"ends_with({path_low}, {q(n[1:])})" if n.startswith("*.") else
                             f"contains({path_low}, {q(n.lower())})" for n in names.split()) + ")"


_IAC_HITS = ", ".join(
    f"CASE WHEN {_file_test('low', r[5])} AND {rx('text', r[6])}" + (f" AND NOT {rx('text', r[7])}" if r[7] else "")
    + f" THEN {q(r[0])} END" for r in LINE_RULES)
_IAC_META = "(VALUES " + ", ".join(
    f"({q(r[0])}, {q(r[1])}, {q(r[2])}, {q(r[3])}, {q(r[4])})" for r in [*LINE_RULES, *FILE_RULES]
) + ") AS m(rule_id, rule_name, severity, cwe, category)"
_K8S = "(ends_with(low, '.yaml') OR ends_with(low, '.yml')) AND contains(content, 'apiVersion:') AND contains(content, 'kind:')"
_DOCKER = "contains(low, 'dockerfile') AND NOT ends_with(low, '.md')"
_ABSENT = {
    "IAC-DOCKER-010": f"{_DOCKER} AND NOT has_user", "IAC-DOCKER-011": f"{_DOCKER} AND NOT contains(content, 'HEALTHCHECK')",
    "IAC-K8S-010": f"{_K8S} AND contains(content, 'containers:') AND NOT contains(content, 'resources:')",
    "IAC-K8S-011": f"{_K8S} AND {has('content', ['kind: Deployment', 'kind: Pod'])} AND NOT contains(content, 'NetworkPolicy')",
    "IAC-TF-010": "ends_with(low, '.tf') AND contains(content, 'aws_s3_bucket') AND NOT contains(content, 'server_side_encryption')",
    "IAC-TF-011": "ends_with(low, '.tf') AND contains(content, 'aws_s3_bucket') AND NOT contains(content, 'versioning')"}
IAC_ROWS = f"""
    iac_lines AS (SELECT repo, path, lower(path) AS low, unnest(lines) AS text, unnest(range(1, len(lines) + 1)) AS line_no
      FROM (SELECT *, {lines_list('content')} AS lines FROM iac_corpus)),
    iac_hits AS (SELECT repo, path, line_no, text, unnest(list_filter([{_IAC_HITS}], lambda x: x IS NOT NULL)) AS rule_id
      FROM iac_lines),
    iac_files AS (SELECT c.repo, c.path, c.content, lower(c.path) AS low, coalesce(u.has_user, false) AS has_user FROM iac_corpus c
      LEFT JOIN (SELECT repo, path, bool_or(starts_with({trim('text')}, 'USER ') AND NOT contains(text, 'root')) AS has_user
      FROM iac_lines GROUP BY ALL) u USING (repo, path)),
    iac_absent AS ({" UNION ALL ".join(f"SELECT repo, path, 1 AS line_no, {q(r[5])} AS text, {q(r[0])} AS rule_id FROM iac_files WHERE {_ABSENT[r[0]]}" for r in FILE_RULES)})"""
_IAC_SELECT = f"""SELECT repo, path, line_no::INT AS line_no, rule_id, rule_name, category, severity, cwe, text
      FROM {{}} JOIN {_IAC_META} USING (rule_id)"""

_ROUTE = {n: m for m in adv.MANIFESTS for n in m[2].split()}


def _dep_select(table):
    parts = []
    for extractor, ecosystem, _ in adv.MANIFESTS:
        for p, a, b in adv.EXTRACTORS[extractor]:
            parts.append(f"SELECT repo, path, {q(ecosystem)} AS ecosystem, unnest(regexp_extract_all(content, {q(p)}, {a})) "
                         f"AS package, unnest(regexp_extract_all(content, {q(p)}, {b})) AS version FROM {table} "
                         f"WHERE extractor = {q(extractor)}")
    return " UNION ALL ".join(parts)


def _parts(v):
    return (f"list_transform(list_filter(list_transform(string_split({v}, '.'), lambda p: regexp_extract(p, '^([0-9]+)', 1)), "
            "lambda d: d <> ''), lambda d: d::BIGINT)")


BELOW = (f"(list_concat({_parts('version')}, list_transform(range(greatest(len({_parts('affected_below')}) - "
         f"len({_parts('version')}), 0)), lambda z: 0::BIGINT)) < list_concat({_parts('affected_below')}, "
         f"list_transform(range(greatest(len({_parts('version')}) - len({_parts('affected_below')}), 0)), lambda z: 0::BIGINT)))")
_ADV = "(VALUES " + ", ".join("(" + ", ".join(q(x) for x in a) + ")" for a in adv.ADVISORIES) + \
    ") AS a(ecosystem, package_key, affected_below, advisory, advisory_severity)"
_RISKY = " UNION ALL ".join(
    f"SELECT repo, path, {trim('text')} AS package_name, '' AS version, {q(v)} AS vulnerability, {q(s)} AS severity FROM dep_lines WHERE {rx('text', p)}"
    for s, v, p in adv.RISKY_LINES)


def deps_ctes(table):
    return f"""
    routed AS (SELECT *, {case_of("list_extract(string_split(path, '/'), -1)", {n: q(m[0]) for n, m in _ROUTE.items()}, 'NULL')} AS extractor,
      {case_of("list_extract(string_split(path, '/'), -1)", {n: q(m[1]) for n, m in _ROUTE.items()}, 'NULL')} AS ecosystem FROM {table}),
    dep_rows AS (SELECT repo, path, ecosystem, package, CASE WHEN coalesce(version, '') = '' THEN 'unknown' ELSE version END AS version
      FROM ({_dep_select('routed')})),
    matched AS (SELECT * FROM dep_rows JOIN {_ADV} USING (ecosystem) WHERE contains(lower(package), package_key)),
    dep_lines AS (SELECT repo, path, unnest({lines_list('content')}) AS text FROM {table}),
    risky AS ({_RISKY}),
    dep_found AS (SELECT repo, path, package AS package_name, version, advisory || ': ' || package_key || ' below ' || affected_below
      AS vulnerability, advisory_severity AS severity FROM matched WHERE {BELOW} UNION ALL SELECT * FROM risky)"""


def hide(text):
    """The text with every credential of a line replaced, as the tables of a scan show it."""
    patterns = [*[p for *_, p in SECRET_RULES], *HIDDEN_ONLY]
    values = ", ".join(f"regexp_extract_all({text}, {q(p)}, 1)" for p in patterns)
    hidden = f"CASE WHEN length(v) < {REDACT_WHOLE} THEN '' ELSE left(v, least({REDACT_KEEP}, length(v) // 4)) END || '****'"
    return (f"list_reduce(list_transform(list_sort(list_transform(list_distinct(list_filter(flatten([{values}]), lambda v: v <> '')), "
            f"lambda v: {{'n': -length(v), 'v': v}})), lambda x: x.v), lambda t, v: replace(t, v, {hidden}), {text})")


def secrets_ctes(name, lines):
    hits = ", ".join(f"CASE WHEN {rx('text', p)} THEN {{'rule_name': {q(n)}, 'description': {q(d)}, 'severity': {q(s)}}} END"
                     for n, d, s, p in SECRET_RULES)
    values = ", ".join(f"regexp_extract_all(text, {q(p)}, 1)" for *_, p in SECRET_RULES)
    hidden = (f"CASE WHEN length(v) < {REDACT_WHOLE} THEN '' ELSE left(v, least({REDACT_KEEP}, length(v) // 4)) END || '****'")
    return f"""
    {name} AS (SELECT repo, path, line_no, text, s.rule_name AS rule_name, s.description AS description, s.severity AS severity,
      list_reduce(list_transform(list_sort(list_transform(list_distinct(list_filter(flatten([{values}]), lambda v: v <> '')),
        lambda v: {{'n': -length(v), 'v': v}})), lambda x: x.v), lambda t, v: replace(t, v, {hidden}), text) AS redacted
      FROM (SELECT *, unnest(list_filter([{hits}], lambda x: x IS NOT NULL)) AS s FROM {lines}))"""


CODE_SECRETS = f"""
    secret_lines AS (SELECT repo, path, unnest(lines) AS text, unnest(range(1, len(lines) + 1)) AS line_no FROM (
      SELECT *, {lines_list('content')} AS lines FROM corpus WHERE {kind()} IN ('Source', 'Config') AND NOT {skipped()}
      AND ({kind()} = 'Config' OR NOT {has('lower(path)', fixed.MINIFIED_MARKS)}))),""" + secrets_ctes("code_secrets", "secret_lines")


# -- chains -----------------------------------------------------------------------

def _txt(steps):
    return " || ' > ' || ".join(f"'{n}|' || {path} || '|' || {line} || '|' || {kind_}" for n, path, line, kind_ in steps)


def _chain_sql(key, table, steps, title=None):
    name, severity, cvss, impact, _ = ch.CHAINS[key]
    return (f"SELECT repo, path, line_no::INT AS line_no, {title or q(name)} AS title, {q(severity)} AS severity, "
            f"{cvss}::DOUBLE AS cvss, {steps} AS steps, {q(key)} AS chain, {q(impact)} AS impact FROM {table}")


def _anchor(key, where):
    steps = [(n, "path", "line_no", q(k)) for n, (_, k) in enumerate(ch.CHAINS[key][4], 1)]
    return _chain_sql(key, f"findings WHERE {where}", _txt(steps))


_INJ = "(category = 'CommandInjection' OR cwe = 'CWE-89')"
COMPANIONS = f"""
    companions AS (SELECT repo, path, min(line_no) FILTER (category = 'PathTraversal') AS traversal_line,
      min(line_no) FILTER (category = 'SSRF') AS ssrf_line, min(line_no) FILTER {_INJ} AS injection_line FROM findings GROUP BY ALL),
    injections AS (SELECT f.repo, f.path, min(f.rule_id) AS injection_rule FROM findings f JOIN companions c ON c.repo = f.repo
      AND c.path = f.path AND c.injection_line = f.line_no WHERE {_INJ} GROUP BY ALL),
    beside AS (SELECT f.*, c.traversal_line, c.ssrf_line, c.injection_line, i.injection_rule FROM findings f
      JOIN companions c USING (repo, path) LEFT JOIN injections i USING (repo, path))"""


def _repo_pair(key, first, second, order):
    steps = [(n, f"{s}_path", f"{s}_line", q(k)) for n, ((_, k), s) in enumerate(zip(ch.CHAINS[key][4], order), 1)]
    table = f"""(SELECT repo, a_path AS path, a_line AS line_no, * EXCLUDE (repo) FROM
      (SELECT repo, path AS a_path, line_no AS a_line FROM findings WHERE {first}
        QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line_no) = 1)
      JOIN (SELECT repo, path AS b_path, line_no AS b_line FROM findings WHERE {second}
        QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line_no) = 1) USING (repo))"""
    return _chain_sql(key, table, _txt(steps))


def _sink_chain(key, sink_type):
    steps = [(n, "path", "line_no" if n == 1 else "sink_line", q(k)) for n, (_, k) in enumerate(ch.CHAINS[key][4], 1)]
    table = f"""(SELECT repo, path, source_line AS line_no, sink_line FROM tgraded WHERE sink_type = {q(sink_type)}
      UNION SELECT repo, path, root_line, sink_line FROM fgraded WHERE sink_type = {q(sink_type)})"""
    return _chain_sql(key, table, _txt(steps))


CHAIN_SQL = {
    "xss_takeover": _anchor("xss_takeover", "category = 'XSS'"),
    "deser_rce": _anchor("deser_rce", f"category = 'InsecureDeserialization' AND {inn('ext', ch.GADGET_EXTENSIONS)}"),
    "proto_rce": _anchor("proto_rce", "category = 'PrototypePollution'"),
    "path_creds": _anchor("path_creds", "category = 'PathTraversal'"),
    "redirect_oauth": _anchor("redirect_oauth", "category = 'OpenRedirect'"),
    "ssrf_internal": _chain_sql("ssrf_internal", "beside WHERE category = 'SSRF'",
                                "'1|' || path || '|' || line_no || '|SSRF' || coalesce(' > 2|' || path || '|' || traversal_line || '|PathTraversal', '')"),
    "xxe_ssrf": _chain_sql("xxe_ssrf", "beside WHERE category = 'XXE' AND ssrf_line IS NOT NULL", _txt([
        (1, "path", "line_no", "'XXE'"), (2, "path", "ssrf_line", "'SSRF'"), (3, "path", "line_no", "'DataExfiltration'")])),
    "auth_escalation": _chain_sql("auth_escalation", "beside WHERE category = 'BrokenAuth'",
                                  "'1|' || path || '|' || line_no || '|BrokenAuth > 2|' || path || '|' || line_no || '|PrivilegeEscalation' "
                                  "|| coalesce(' > 3|' || path || '|' || injection_line || '|' || injection_rule, '')"),
    "crypto_secret": _repo_pair("crypto_secret", "category = 'HardcodedSecret'",
                                f"category = 'WeakCrypto' AND NOT {has('lower(text)', ch.CHECKSUM_WORDS)}", "ab"),
    "sqli_auth_repo": _repo_pair("sqli_auth_repo", "category = 'BrokenAuth'", "cwe = 'CWE-89'", "abb"),
    "token_in_logs": _anchor("token_in_logs", f"category = 'InfoDisclosure' AND {starts('rule_id', ch.TOKEN_LOG_PREFIXES)}"),
    "tainted_exec": _chain_sql(
        "tainted_exec", "(SELECT *, source_line AS line_no FROM tgraded WHERE NOT is_sanitized AND sink_type IN ('sql_execution', 'command_execution'))",
        "'1|' || path || '|' || source_line || '|taint_source > 2|' || path || '|' || sink_line || '|' || sink_type",
        "'Taint-confirmed ' || CASE sink_type WHEN 'sql_execution' THEN 'SQL Injection' ELSE 'Command Injection' END || ' via ' || source_type"),
    "log_forging": _sink_chain("log_forging", "log_injection"),
    "template_rce": _sink_chain("template_rce", "template_injection"),
}
CHAINS_CTE = COMPANIONS + ",\n    chains AS (" + "\n UNION ALL ".join(CHAIN_SQL.values()) + ")"

CROSS = """
    crossed AS (SELECT f.* FROM findings f WHERE NOT EXISTS (SELECT 1 FROM composites c WHERE c.repo = f.repo
      AND c.path = f.path AND c.line_no = f.line_no))"""

STEPS = """
    mid AS (SELECT DISTINCT p.repo, p.path, p.flow_id, d.line_no, d.variable FROM fgraded p JOIN derived d ON d.repo = p.repo
        AND d.path = p.path AND d.root = p.root AND d.root_line = p.root_line AND d.line_no < p.sink_line WHERE p.hops = 0
      UNION ALL SELECT repo, path, flow_id, from_line, variable FROM fgraded WHERE hops = 1),
    mids AS (SELECT repo, path, flow_id, list({'line_no': line_no, 'variable': variable} ORDER BY line_no, variable) AS middle
      FROM mid GROUP BY ALL)"""


# Everything a scan of the code corpus returns, in the report shape.
_DEP = "'DEP-' || upper(replace(vulnerability, ' ', '-'))"
_CHAIN = "'CHAIN-' || upper(replace(title, ' ', '-'))"


def _mark(kind_, *parts):
    return f"'{kind_}-' || repo || '-' || path || '-' || " + " || '-' || ".join(parts)


FULL = [CODE, SOURCES, COMMENTS, RAW, FREED, DOUBLE, FOUND, COMPOSITE, TAINT, FLOW, STEPS, CODE_SECRETS,
        f"dep_corpus AS (SELECT * FROM corpus WHERE {kind()} = 'Dependency' AND NOT {skipped()})", deps_ctes("dep_corpus"),
        IAC, IAC_ROWS, f"iac_found AS ({_IAC_SELECT.format('iac_hits')} UNION ALL {_IAC_SELECT.format('iac_absent')})",
        CROSS, CHAINS_CTE, f"""
    n_middle AS (SELECT repo, path, flow_id, len(middle) AS n FROM mids),
    everything AS MATERIALIZED (
      SELECT 'pattern' AS kind, repo, path, line_no, rule_id AS rule_key, severity, category, cwe AS tag, rule_name, 'high' AS precision,
        NULL::VARCHAR AS confidence, sha256(rule_id || ':' || path || ':' || line_no) AS mark, false AS clean,
        rule_name || ': ' || cwe AS message, text AS shown, 0 AS n_steps, 0 AS n_related FROM crossed
      UNION ALL SELECT 'composite', repo, path, line_no, rule_id, severity, 'composite-rule', 'composite-rule ' || cwe, rule_name,
        lower(confidence), confidence, {_mark('composite', 'rule_id', 'line_no')}, false, rule_name || ': ' || cwe, text, 0, 0 FROM composites
      UNION ALL SELECT 'taint', repo, path, sink_line, 'TAINT-' || upper(sink_type), severity, 'taint-flow', 'taint-analysis',
        'Taint Flow to ' || sink_type, CASE WHEN confidence = 'HIGH' THEN 'high' ELSE 'medium' END, confidence,
        {_mark('taint', 'source_line', 'sink_line', 'sink_type')}, false, description, sink_text, 2, 1 FROM tgraded
      UNION ALL SELECT 'flow', repo, path, sink_line, 'FLOW-' || upper(sink_type), severity, 'data-flow', 'data-flow ' || cwe,
        'Data Flow to ' || sink_type, lower(confidence), confidence, {_mark('flow', 'root_line', 'sink_line', 'sink_type')}, is_sanitized,
        description, sink_text, 4 + coalesce(n, 0), 0 FROM fgraded LEFT JOIN n_middle USING (repo, path, flow_id)
      UNION ALL SELECT 'secret', repo, path, line_no, 'SECRET-' || upper(replace(rule_name, ' ', '-')), severity, 'secret-detection', 'secret',
        rule_name, 'high', 'HIGH', {_mark('secret', 'line_no', 'rule_name')}, false, rule_name || ': ' || description, text, 0, 0 FROM code_secrets
      UNION ALL SELECT 'dependency', repo, path, 1, {_DEP}, severity, 'dependency-vulnerability', 'dependency',
        'Vulnerable Dependency: ' || package_name, 'high', 'HIGH', {_mark('dep', 'package_name', 'vulnerability')}, false,
        package_name || '@' || version || ': ' || vulnerability, package_name || '@' || version, 0, 0 FROM dep_found
      UNION ALL SELECT 'iac', repo, path, line_no, rule_id, severity, 'iac-' || lower(category), 'iac ' || category || ' ' || cwe, rule_name,
        'high', 'HIGH', {_mark('iac', 'rule_id', 'line_no')}, false, '[' || category || '] ' || rule_name || ': ' || cwe, text, 0, 0 FROM iac_found
      UNION ALL SELECT 'chain', repo, path, line_no, {_CHAIN}, severity, 'attack-chain', 'attack-chain', title,
        'medium', 'MEDIUM', {_mark('chain', 'line_no', 'title')}, false, title || ' (CVSS ~' || printf('%.1f', cvss) || '): ' || impact, '', 0,
        len(string_split(steps, ' > ')) FROM chains)"""]

_COUNT = {"pattern": "total_vulnerabilities", "secret": "total_secrets", "dependency": "total_dep_issues",
          "taint": "total_taint_flows", "flow": "total_flow_paths", "composite": "total_composite", "iac": "total_iac",
          "chain": "total_chains"}
SUMMARY = [*FULL, f"""
    scanned AS (SELECT repo, count(*) AS files, sum(CASE WHEN {kind()} = 'Source' THEN len({lines_list('content')}) ELSE 0 END)::BIGINT
      AS lines FROM corpus WHERE {kind()} IS NOT NULL AND NOT {skipped()} GROUP BY repo),
    totals AS (SELECT repo, {', '.join(f"count(*) FILTER (kind = '{k}') AS {c}" for k, c in _COUNT.items())},
      {', '.join(f"count(*) FILTER (kind = 'pattern' AND severity = '{s}') AS {s.lower()}" for s in fixed.SEVERITY_SCORES)},
      count(*) FILTER (kind = 'flow' AND clean) AS sanitized_flows FROM everything GROUP BY repo),
    summary AS (SELECT s.repo, s.files, s.lines, {', '.join(f'coalesce({c}, 0) AS {c}' for c in [*_COUNT.values(), *[s.lower() for s in fixed.SEVERITY_SCORES], 'sanitized_flows'])}
      FROM scanned s LEFT JOIN totals USING (repo)),
    issues AS (SELECT repo, {' + '.join(c for k, c in _COUNT.items() if k != 'chain')} - sanitized_flows AS total_issues FROM summary)"""]

_ORDER = "list_position(['pattern', 'taint', 'secret', 'dependency', 'composite', 'flow', 'iac', 'chain'], kind)"
REPORT = [*FULL, f"""
    reported AS (SELECT * FROM everything WHERE NOT clean),
    descriptors AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_ORDER}, rule_key)::INT - 1 AS rule_index FROM (
      SELECT repo, kind, rule_key, severity, rule_name, tag, precision FROM reported QUALIFY row_number() OVER (PARTITION BY repo, kind, rule_key
      ORDER BY path, line_no, severity, rule_name, tag, precision) = 1))"""]
LEVEL = case_of("severity", {k: q(v) for k, v in fixed.REPORT_LEVELS.items()}, "'warning'")
RSCORE = case_of("severity", {k: q(v) for k, v in fixed.REPORT_SCORES.items()}, "'1.0'")
URI = "CASE WHEN starts_with({0}, '/') THEN ltrim(substring({0}, 2), '/') ELSE {0} END"

CLASSIFIED = f"classified AS (SELECT *, {kind()} AS kind FROM corpus)"
def condition_sql(cond):
    return with_(CODE, SOURCES, _conditions([(" ".join(derived.EXTENSIONS), "R", cond)], "c"),
                 final="SELECT path, line_no::INT AS line_no FROM c_hits")


def _shape(rows):
    return f"SELECT {rows}"


@cache
def oracle() -> dict:
    from linesieve import queries as reg
    code, src = [CODE], [CODE, SOURCES]
    flow_fields = "path, sink_line::INT AS sink_line, sink_type, from_line::INT AS from_line, variable, root_line::INT AS root_line, root, source_type"
    walk = f"""WITH RECURSIVE nodes AS (SELECT event_id AS id, list_extract([{', '.join(q(t) for t in derived.NODE_TYPES)}], (event_id % {len(derived.NODE_TYPES)})::INT + 1) AS node_type FROM events),
            edges AS (SELECT src, src + step AS dst FROM (SELECT event_id AS src, unnest(list_filter([1, CASE WHEN event_id % 4 = 0 THEN 3 END, CASE WHEN event_id % 6 = 0 THEN 5 END, CASE WHEN event_id % 9 = 0 THEN -2 END], lambda s: s IS NOT NULL)) AS step FROM events)
              WHERE src + step IN (SELECT event_id FROM events)),
            walk(source_id, last, path, kind, clean) AS (SELECT id, id, [id], node_type, false FROM nodes WHERE node_type = 'Source'
              UNION ALL SELECT w.source_id, n.id, list_append(w.path, n.id), n.node_type, w.clean OR n.node_type = 'Sanitizer' FROM walk w
              JOIN edges e ON e.src = w.last JOIN nodes n ON n.id = e.dst WHERE w.kind <> 'Sink' AND NOT list_contains(w.path, n.id) AND len(w.path) < {reg.PATH_NODES})"""
    out = {
        "corpus_load": with_(NATURAL, final="SELECT repo, path, ext, size::BIGINT AS size FROM nat"),
        "classify_files": with_(*code, CLASSIFIED, final="SELECT repo, path, ext, kind FROM classified WHERE kind IS NOT NULL"),
        "skip_dirs": with_(*code, final=f"SELECT repo, path FROM corpus WHERE NOT {skipped()}"),
        "size_guard": with_(*code, CLASSIFIED, final=f"SELECT path, kind, size::BIGINT AS size FROM classified WHERE kind IS NOT NULL AND (kind <> 'Source' OR size <= {reg.SMALL_BYTES})"),
        "binary_guard": """WITH t AS (SELECT source AS repo, '/b/' || doc_id || '.py' AS path, CASE WHEN doc_id % 3 = 0
            THEN text || chr(0) ELSE text END AS body, doc_id % 3 = 0 AS marked FROM documents)
            SELECT repo, path, strlen(body)::BIGINT AS size FROM t WHERE NOT marked""",
        "utf8_guard": "SELECT doc_id, length(text)::INT AS n_chars FROM documents WHERE doc_id % 2 = 0",
        "lines_guard": with_(*code, CLASSIFIED, final=f"SELECT path, kind FROM classified WHERE kind IS NOT NULL AND (kind <> 'Source' OR len({lines_list('content')}) <= {reg.FEW_LINES})"),
        "minified_guard": with_(*code, CLASSIFIED, final=f"SELECT path, kind FROM classified WHERE kind IS NOT NULL AND (kind <> 'Source' OR NOT {has('lower(path)', fixed.MINIFIED_MARKS)})"),
        "is_test_path": with_(*code, final="SELECT repo, path, is_test FROM corpus"),
        "drop_tests": with_(*code, CLASSIFIED, final="SELECT path, kind FROM classified WHERE kind IS NOT NULL AND (kind <> 'Source' OR NOT is_test)"),
        "ext_lang": with_(*code, final="SELECT ext, count(*) AS files FROM corpus GROUP BY ext"),
        "catalog_load": with_(*src, COMMENTS, RAW, final=f"SELECT m.rule_id, m.category, m.severity, m.cwe, count(r.rule_id) AS hits FROM {_META} LEFT JOIN raw r USING (rule_id) GROUP BY ALL"),
        "explode_lines": with_(NATURAL, final="SELECT repo, path, line_no::INT AS line_no, text FROM natural_lines"),
        "comment_mask": with_(*code, f"lines AS (SELECT repo, path, ext, is_test, unnest(lines) AS text, unnest(range(1, len(lines) + 1)) AS line_no FROM (SELECT *, {lines_list('content')} AS lines FROM corpus))", COMMENTS,
                              final="SELECT path, line_no::INT AS line_no, is_comment FROM masked"),
        "line_count": with_(NATURAL, final=f"SELECT repo, count(*) AS files, sum(len({lines_list('content')}))::BIGINT AS lines FROM nat GROUP BY repo"),
        "context_window": with_(*src, final=f"""SELECT path, line_no::INT AS line_no,
            coalesce(string_agg(text, chr(10)) OVER ({KEY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS before,
            coalesce(string_agg(text, chr(10)) OVER ({KEY} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS after FROM lines"""),
        "indent": with_(*code, f"l AS (SELECT path, unnest(lines) AS text, unnest(range(1, len(lines) + 1)) AS line_no FROM (SELECT path, {lines_list('content')} AS lines FROM corpus))",
                        final=f"SELECT path, line_no::INT AS line_no, {indent('text')} AS indent FROM l"),
        "scope": with_(*src, TAINT, f"""
            targets AS (SELECT DISTINCT m.repo, m.path, m.line_no, m.indent FROM measured m JOIN tsink k ON k.repo = m.repo AND k.path = m.path AND k.line_no = m.line_no),
            fn AS (SELECT t.repo, t.path, t.line_no, arg_max(h.name, h.line_no) AS name, max(h.line_no) AS at_no, arg_max(h.is_test, h.line_no) AS is_test
              FROM targets t JOIN fn_heads h ON h.repo = t.repo AND h.path = t.path AND h.line_no <= t.line_no AND (h.indent <= t.indent OR h.indent = 0) GROUP BY ALL),
            cl AS (SELECT t.repo, t.path, t.line_no, arg_max(h.name, h.line_no) AS name, max(h.line_no) AS at_no
              FROM targets t JOIN cl_heads h ON h.repo = t.repo AND h.path = t.path AND h.line_no <= t.line_no AND (h.indent <= t.indent OR h.indent = 0) GROUP BY ALL),
            named AS (SELECT t.*, fn.name AS function_name, cl.name AS class_name, coalesce(fn.is_test, false) AS in_test,
              CASE WHEN fn.at_no IS NOT NULL AND cl.at_no IS NOT NULL THEN least(fn.at_no, cl.at_no) ELSE 1 END AS top
              FROM targets t LEFT JOIN fn USING (repo, path, line_no) LEFT JOIN cl USING (repo, path, line_no)),
            around AS (SELECT n.repo, n.path, n.line_no, bool_or({rx('b.text', flows.TRY_HEADER)}) AS in_try, bool_or({rx('b.text', flows.LOOP_HEADER)}) AS in_loop
              FROM named n JOIN measured b ON b.repo = n.repo AND b.path = n.path AND b.line_no BETWEEN n.top AND n.line_no AND (b.indent < n.indent OR b.line_no = n.line_no) GROUP BY ALL)""",
                       final="SELECT path, line_no::INT AS line_no, function_name, class_name, in_try, in_loop, in_test FROM named JOIN around USING (repo, path, line_no)"),
        "pattern_scan": with_(*PATTERNS, final="SELECT repo, path, line_no::INT AS line_no, rule_id, rule_name, category, severity, cwe, matched_text, confidence FROM findings"),
        "language_gate": with_(*src, COMMENTS, RAW, final="SELECT ext, rule_id, count(*) AS hits FROM raw GROUP BY ALL"),
        "comment_gate": with_(*src, COMMENTS, RAW, final="SELECT path, line_no::INT AS line_no, rule_id, matched_text FROM raw"),
        "use_after_free": with_(*src, COMMENTS, RAW, FREED, final=f"SELECT path, line_no::INT AS line_no, matched_text FROM raw WHERE rule_id = 'C-UAF-001' AND {_UAF}"),
        "alloc_null_check": with_(*src, COMMENTS, RAW, FREED, final=f"SELECT path, line_no::INT AS line_no, matched_text FROM raw WHERE rule_id = 'C-MEM-002' AND {_ALLOC}"),
        "defensive_code": with_(*src, COMMENTS, RAW, final=f"SELECT path, line_no::INT AS line_no, rule_id FROM raw WHERE NOT {_DEFENSIVE}"),
        "fingerprints": with_(*PATTERNS, final="SELECT rule_id, path, line_no::INT AS line_no, sha256(rule_id || ':' || path || ':' || line_no) AS fingerprint FROM findings"),
        "path_confidence": with_(*PATTERNS, final="SELECT confidence, count(*) AS findings FROM findings GROUP BY ALL"),
        "severity_scores": with_(*PATTERNS, final=f"SELECT severity, {score('severity')} AS score, count(*) AS findings FROM findings GROUP BY ALL"),
        "double_free": with_(*src, DOUBLE, final="SELECT path, line_no::INT AS line_no, pointer, 'C-MEM-001' AS rule_id FROM doubled"),
        "composite_scan": with_(*src, COMPOSITE, final="SELECT repo, path, line_no::INT AS line_no, rule_id, rule_name, category, severity, cwe, owasp, confidence FROM composites"),
        "condition_compile": with_(*src, COMPOSITE, final=f"SELECT m.rule_id, m.category, m.confidence, count(h.rule_id) AS hits FROM {_COMP_META} LEFT JOIN comp_hits h USING (rule_id) GROUP BY ALL"),
        "taint_sources": with_(*TAINTED, final="SELECT path, line_no::INT AS line_no, variable, source_type FROM tsrc"),
        "false_source_filter": with_(*src, f"near AS (SELECT path, line_no, text, {ABOVE} FROM lines)", final=f"SELECT path, line_no::INT AS line_no FROM near WHERE {false_source()}"),
        "taint_sinks": with_(*TAINTED, final="SELECT path, line_no::INT AS line_no, sink_type, sink_severity AS severity FROM tsink"),
        "source_sink_join": with_(*TAINTED, final="SELECT path, variable, source_line::INT AS source_line, source_type, sink_line::INT AS sink_line, sink_type FROM tpairs"),
        "safe_call_filter": with_(*TAINTED, final="SELECT path, line_no::INT AS line_no FROM tsink WHERE sink_type = 'command_execution'"),
        "sanitized_between": with_(*TAINTED, final="SELECT path, source_line::INT AS source_line, variable, sink_line::INT AS sink_line, sink_type, is_sanitized, sanitizer_info FROM tgraded"),
        "sink_scope": with_(*TAINTED, final="SELECT DISTINCT path, sink_line::INT AS sink_line, in_test_scope FROM taints"),
        "taint_grade": with_(*TAINTED, final="SELECT path, source_line::INT AS source_line, variable, sink_line::INT AS sink_line, sink_type, severity, confidence, in_test FROM tgraded"),
        "taint_rows": with_(*TAINTED, final="SELECT repo, path, source_text, sink_text, description FROM tgraded"),
        "flow_sources": with_(*src, FLOW_BASE, final="SELECT path, line_no::INT AS line_no, variable, source_type FROM fsrc"),
        "flow_sinks": with_(*src, FLOW_BASE, final="SELECT path, line_no::INT AS line_no, sink_type, sink_severity AS severity, cwe FROM fsink"),
        "assignments": with_(*src, FLOW_BASE, final="SELECT path, line_no::INT AS line_no, variable, side FROM assigns"),
        "propagate": with_(*FLOWING, final="SELECT path, line_no::INT AS line_no, variable, root_line::INT AS root_line, root, source_type FROM derived"),
        "direct_flow": with_(*FLOWING, final=f"SELECT {flow_fields} FROM flows WHERE hops = 0"),
        "propagated_flow": with_(*FLOWING, final=f"SELECT {flow_fields} FROM flows WHERE hops = 1"),
        "flow_sanitized": with_(*FLOWING, final=f"SELECT {flow_fields}, hops, is_sanitized FROM flows"),
        "flow_grade": with_(*FLOWING, final="SELECT path, sink_line::INT AS sink_line, sink_type, root_line::INT AS source_line, root AS source_var, from_line::INT AS from_line, variable, severity, confidence, cwe, description FROM fgraded"),
        "flow_steps": with_(*FLOWING, STEPS, final="""SELECT path, sink_line::INT AS sink_line, sink_type, root_line::INT AS source_line, from_line::INT AS from_line, variable, hops,
            root_line || '|source|' || root || ' > ' || coalesce(list_aggregate(list_transform(middle, lambda m: m.line_no || '|propagation|' || m.variable || ' > '), 'string_agg', ''), '')
            || sink_line || '|sink|' || variable AS steps FROM fgraded LEFT JOIN mids USING (repo, path, flow_id)"""),
        "flow_id": with_(*FLOWING, final="SELECT path, flow_id, sink_line::INT AS sink_line, sink_type, from_line::INT AS from_line, variable FROM fgraded"),
        "source_to_sink_paths": walk + """
            SELECT source_id, last AS sink_id, array_to_string(path, '>') AS path, len(path)::INT AS length, clean AS is_sanitized FROM walk WHERE kind = 'Sink'""",
        "witness_paths": walk + """
            SELECT source_id, last AS sink_id, array_to_string(path, '>') AS path, len(path)::INT AS length FROM walk WHERE kind = 'Sink'
            QUALIFY row_number() OVER (PARTITION BY source_id, last ORDER BY len(path), path) = 1""",
        "file_pattern": with_(IAC, final="SELECT path, rule_sets FROM (SELECT path, (" + " + ".join(
            f"CASE WHEN {_file_test('lower(path)', g)} THEN 1 ELSE 0 END" for g in sorted({r[5] for r in LINE_RULES})) + ")::INT AS rule_sets FROM iac_corpus) WHERE rule_sets > 0"),
        "iac_line_rules": with_(IAC, IAC_ROWS, final=_IAC_SELECT.format("iac_hits")),
        "absence_rules": with_(IAC, IAC_ROWS, final=_IAC_SELECT.format("iac_absent")),
        "manifest_route": with_(MANIFESTS, deps_ctes("manifests"), final="SELECT path, extractor, ecosystem FROM routed"),
        "manifest_deps": with_(MANIFESTS, deps_ctes("manifests"), final="SELECT path, ecosystem, package, version FROM dep_rows"),
        "advisory_match": with_(MANIFESTS, deps_ctes("manifests"), final=f"""SELECT repo, path, ecosystem AS package_manager, package AS package_name, version,
            advisory || ': ' || package_key || ' below ' || affected_below AS vulnerability, advisory_severity AS severity, 'Use ' || affected_below || ' or newer' AS advice FROM matched WHERE {BELOW}"""),
        "version_compare": with_(MANIFESTS, deps_ctes("manifests"), final=f"SELECT DISTINCT ecosystem, version, affected_below, {BELOW} AS below FROM dep_rows JOIN {_ADV} USING (ecosystem)"),
        "risky_dep_lines": with_(MANIFESTS, deps_ctes("manifests"), final="SELECT path, package_name, vulnerability, severity FROM risky"),
        "dep_group": with_(MANIFESTS, deps_ctes("manifests"), final="""SELECT package_name, version, vulnerability, count(*) AS total, count(DISTINCT path) AS files, min(severity) AS severity,
            array_to_string(list_slice(list_sort(list(DISTINCT path)), 1, 3), ' ') AS first_files FROM dep_found GROUP BY package_name, version, vulnerability"""),
        "secret_scan": with_(NATURAL, CODE, secrets_ctes("nat_secrets", "natural_lines"), CODE_SECRETS, final="""SELECT repo, path, line_no::INT AS line_no, rule_name, severity FROM nat_secrets
            UNION ALL SELECT repo, path, line_no::INT, rule_name, severity FROM code_secrets"""),
        "redact": with_(NATURAL, secrets_ctes("nat_secrets", "natural_lines"), final="SELECT path, line_no::INT AS line_no, rule_name, redacted FROM nat_secrets"),
        "secret_dedupe": with_(NATURAL, secrets_ctes("nat_secrets", "natural_lines"), final="SELECT DISTINCT rule_name, path, line_no::INT AS line_no FROM nat_secrets"),
        "secret_groups": with_(NATURAL, CODE, secrets_ctes("nat_secrets", "natural_lines"), CODE_SECRETS, """
            both_secrets AS (SELECT path, line_no, rule_name, description, severity FROM nat_secrets UNION ALL SELECT path, line_no, rule_name, description, severity FROM code_secrets),
            spots AS (SELECT DISTINCT rule_name, path, line_no FROM both_secrets),
            places AS (SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY path, line_no) AS rn FROM spots)""",
                               final="""SELECT s.rule_name, s.description, s.severity, count(*) AS total, count(DISTINCT s.path || ':' || s.line_no) AS unique_locations,
            any_value(l.locations) AS locations FROM both_secrets s JOIN (SELECT rule_name, string_agg(path || ':' || line_no, ' ' ORDER BY path, line_no) AS locations FROM places WHERE rn <= 3 GROUP BY rule_name) l
            ON l.rule_name = s.rule_name GROUP BY s.rule_name, s.description, s.severity"""),
        "finding_dedupe": with_(*src, COMMENTS, RAW, FREED, DOUBLE, FOUND, final="SELECT DISTINCT rule_id, path, line_no::INT AS line_no, matched_text FROM findings WHERE rule_id <> 'C-MEM-001'"),
        "cross_engine_anti": with_(*PATTERNS, COMPOSITE, CROSS, final="SELECT rule_id, path, line_no::INT AS line_no FROM crossed"),
        "severity_sort": with_(*PATTERNS, COMPOSITE, CROSS, final=f"SELECT {score('severity')} AS score, path, line_no::INT AS line_no, rule_id FROM crossed ORDER BY 1 DESC, repo, 2, 3, 4"),
        "min_severity": with_(*PATTERNS, final=f"SELECT rule_id, path, line_no::INT AS line_no, severity FROM findings WHERE {score('severity')} >= 8"),
        "result_caps": with_(*PATTERNS, final=f"SELECT {score('severity')} AS score, path, line_no::INT AS line_no, rule_id FROM findings ORDER BY score DESC, repo, path, findings.line_no, rule_id LIMIT 100"),
        "rule_groups": with_(*PATTERNS, "ranked AS (SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY repo, path, line_no, rule_id) AS rn FROM findings)",
                             final="""SELECT rule_name, count(*) AS occurrences, arg_min(rule_id, rn) AS rule_id, arg_min(severity, rn) AS severity, arg_min(cwe, rn) AS cwe,
            string_agg(path || ':' || line_no, ' ' ORDER BY rn) FILTER (rn <= 5) AS locations FROM ranked GROUP BY rule_name"""),
        "all_findings": with_(*FULL, final="SELECT kind, rule_key, severity, count(*) AS findings, min(path) AS first_path FROM everything GROUP BY kind, rule_key, severity"),
        "top_lists": with_(*TAINTED, FLOW, IAC, IAC_ROWS, f"iac_found AS ({_IAC_SELECT.format('iac_hits')} UNION ALL {_IAC_SELECT.format('iac_absent')})", """
            listed AS (SELECT 'taint' AS kind, 50 AS most, path, sink_line AS line_no, concat_ws(' ', sink_type, source_line, variable) AS label, severity FROM tgraded
              UNION ALL SELECT 'flow', 30, path, sink_line, concat_ws(' ', sink_type, from_line, variable, root_line, root, source_type), severity FROM fgraded
              UNION ALL SELECT 'iac', 50, path, line_no, rule_id, severity FROM iac_found)""",
                           final="""SELECT kind, rank::INT AS rank, path, line_no::INT AS line_no, label, severity FROM (SELECT *,
            row_number() OVER (PARTITION BY kind ORDER BY path, line_no, label, severity) AS rank FROM listed) WHERE rank <= most"""),
        "scan_summary": with_(*SUMMARY, final="SELECT * FROM summary"),
        "total_issues": with_(*SUMMARY, final="SELECT * FROM issues"),
        "sanitized_split": with_(*FLOWING, final="SELECT repo, count(*) FILTER (is_sanitized) AS sanitized, count(*) FILTER (NOT is_sanitized) AS unsanitized FROM flows GROUP BY repo"),
        "risk_label": with_(*SUMMARY, final="SELECT repo, CASE WHEN total_issues = 0 THEN 'NONE' WHEN critical > 0 THEN 'CRITICAL' WHEN high > 0 THEN 'HIGH' ELSE 'MODERATE' END AS risk FROM summary JOIN issues USING (repo)"),
        "gate": with_(*SUMMARY, final="SELECT repo, CASE WHEN critical > 0 OR total_chains > 0 THEN 2 WHEN total_vulnerabilities > 0 OR total_secrets > 0 THEN 1 ELSE 0 END AS gate FROM summary"),
        "findings_by_file": with_(*PATTERNS, final="SELECT repo, path, count(*) AS findings, min(line_no)::INT AS first_line, array_to_string(list_sort(list(DISTINCT category)), ' ') AS categories FROM findings GROUP BY repo, path"),
        "sarif_rules": with_(*REPORT, final=f"SELECT repo, kind, rule_key, rule_index, rule_name, {LEVEL} AS level, {RSCORE} AS security_severity, tag, precision FROM descriptors"),
        "sarif_results": with_(*REPORT, final=f"SELECT r.repo, r.kind, r.rule_key, d.rule_index, {LEVEL.replace('CASE severity', 'CASE r.severity')} AS level, {URI.format('path')} AS uri, line_no::INT AS line_no, mark AS line_hash, category, confidence FROM reported r JOIN descriptors d USING (repo, kind, rule_key)"),
        "sarif_code_flows": with_(*TAINTED, FLOW, STEPS, final=f"""
            SELECT {URI.format('path')} AS uri, rule_key, line_no::INT AS line_no, fingerprint, position::INT AS position, step_line::INT AS step_line, step, nesting FROM (
              SELECT path, 'TAINT-' || upper(sink_type) AS rule_key, sink_line AS line_no, {_mark('taint', 'source_line', 'sink_line', 'sink_type')} AS fingerprint,
                unnest([1, 2]) AS position, unnest([source_line, sink_line]) AS step_line, unnest(['source', 'sink']) AS step, 0 AS nesting FROM tgraded
              UNION ALL SELECT path, 'FLOW-' || upper(sink_type), sink_line, {_mark('flow', 'root_line', 'sink_line', 'sink_type')},
                unnest(range(1, len(spots) + 1)), unnest(spots), unnest(list_concat(['source'], list_transform(spots[2:-2], lambda x: 'pass-through'), ['sink'])),
                unnest(list_concat([0], list_transform(spots[2:-2], lambda x: 1), [0])) FROM (
                SELECT *, list_concat([root_line, root_line], coalesce(list_transform(middle, lambda m: m.line_no), []), [sink_line, sink_line]) AS spots
                FROM fgraded LEFT JOIN mids USING (repo, path, flow_id) WHERE NOT is_sanitized))"""),
        "sarif_related": with_(*PATTERNS, TAINT, FLOW, CHAINS_CTE, final=f"""
            SELECT {URI.format('path')} AS uri, rule_key, line_no::INT AS line_no, id::INT AS id, {URI.format('at_path')} AS related_uri, at_line::INT AS at_line FROM (
              SELECT path, 'TAINT-' || upper(sink_type) AS rule_key, sink_line AS line_no, 1 AS id, path AS at_path, source_line AS at_line FROM tgraded
              UNION ALL SELECT path, {_CHAIN}, line_no, list_extract(parts, 1)::INT, list_extract(parts, 2), list_extract(parts, 3)::INT FROM (
                SELECT path, title, line_no, string_split(unnest(string_split(steps, ' > ')), '|') AS parts FROM chains))"""),
        "sarif_messages": with_(*REPORT, final=f"""SELECT repo, kind, rule_key, {URI.format('path')} AS uri, line_no::INT AS line_no, message,
            {hide('shown')} AS snippet, n_steps::INT AS n_steps, n_related::INT AS n_related FROM reported"""),
        "sarif_document_values": with_(*REPORT, final=f"""SELECT r.repo, r.rule_key, r.rule_key AS indexed_rule, d.rule_index, {LEVEL.replace('CASE severity', 'CASE r.severity')} AS level,
            message, {URI.format('path')} AS uri, line_no::INT AS line_no, {hide('shown')} AS snippet, mark AS line_hash, n_steps::INT AS n_steps, n_related::INT AS n_related,
            confidence, category FROM reported r JOIN descriptors d USING (repo, kind, rule_key)"""),
        "json_report_values": with_(*SUMMARY, final="""SELECT e.repo, s.files, s.total_vulnerabilities, s.total_chains, kind, path, line_no::INT AS line_no, rule_key, severity, message, category
            FROM everything e JOIN summary s USING (repo) WHERE NOT clean"""),
        "sarif_step_texts": with_(*TAINTED, FLOW, STEPS, final=f"""
            SELECT uri, rule_key, line_no::INT AS line_no, position::INT AS position, {hide('step_text')} AS step_text FROM (
              SELECT {URI.format('path')} AS uri, 'TAINT-' || upper(sink_type) AS rule_key, sink_line AS line_no, unnest([1, 2]) AS position,
                unnest([source_text, sink_text]) AS step_text FROM tgraded
              UNION ALL SELECT {URI.format('path')}, 'FLOW-' || upper(sink_type), sink_line, unnest(range(1, len(texts) + 1)), unnest(texts) FROM (
                SELECT f.*, list_concat(['Source: ' || root || ' (' || source_type || ')', t.text], coalesce(list_transform(between_texts, lambda b: b.text), []),
                  [sink_text, 'Sink: ' || sink_type]) AS texts
                FROM fgraded f JOIN lines t ON t.repo = f.repo AND t.path = f.path AND t.line_no = f.root_line LEFT JOIN (
                  SELECT m.repo, m.path, m.flow_id, list({{'line_no': m.line_no, 'variable': m.variable, 'text': l.text}} ORDER BY m.line_no, m.variable) AS between_texts
                  FROM mid m JOIN lines l ON l.repo = m.repo AND l.path = m.path AND l.line_no = m.line_no GROUP BY ALL) b
                ON b.repo = f.repo AND b.path = f.path AND b.flow_id = f.flow_id WHERE NOT is_sanitized))"""),
        "level_map": with_(*PATTERNS, final=f"SELECT severity, {LEVEL} AS level, {RSCORE} AS score, count(*) AS findings FROM findings GROUP BY ALL"),
        "relative_paths": with_(*code, final="SELECT path, CASE WHEN starts_with(path, '/src') THEN ltrim(substring(path, 5), '/') ELSE path END AS uri FROM corpus"),
    }
    out |= {f"condition_{n}": condition_sql(c) for n, c in {
        "leaf": reg.LEAF, "all_of": reg.ALL, "any_of": reg.ANY, "none_near": reg.NEAR, "inside": reg.INSIDE,
        "not_inside": reg.NOT_INSIDE}.items()}
    cols = "SELECT repo, path, line_no, title, severity, cvss, steps FROM"
    for key, sql in CHAIN_SQL.items():
        if key == "tainted_exec":
            ctes = TAINTED
        elif key in ("log_forging", "template_rce"):
            ctes = [*TAINTED, FLOW]
        else:
            ctes = [*PATTERNS, COMPANIONS]
        out[key] = with_(*ctes, final=f"{cols} ({sql})")
    return {k: ("WITH RECURSIVE" + v[4:] if v.startswith("WITH ") and " grow(" in v else v) for k, v in out.items()}
