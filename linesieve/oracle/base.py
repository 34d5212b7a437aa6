"""DuckDB forms of the derived tables and line facts, as named CTEs.

The line facts use windows and range joins over an exploded line table, where
the engine works inside a file's array, so the two agree only if both are right.
"""

from linesieve.catalog import files as fixed
from linesieve.catalog import flows
from linesieve.sources import derived


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def ql(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def inn(value, words) -> str:
    return f"({value} IN ({', '.join(q(w) for w in words)}))"


def rx(text, pattern) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def rxg(text, pattern, group=0) -> str:
    return f"regexp_extract({text}, {q(pattern)}, {group})"


def has(text, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def starts(text, words) -> str:
    return "(" + " OR ".join(f"starts_with({text}, {q(w)})" for w in words) + ")"


def ends(text, words) -> str:
    return "(" + " OR ".join(f"ends_with({text}, {q(w)})" for w in words) + ")"


WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def trim(text) -> str:
    return f"trim({text}, {WS})"


def case_of(value, table, default) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


def score(label) -> str:
    return case_of(f"upper({label})", fixed.SEVERITY_SCORES, 1)


def lines_list(content) -> str:
    return (f"CASE WHEN {content} = '' THEN [] ELSE "
            f"string_split_regex(regexp_replace({content}, '\\r?\\n\\z', ''), '\\r?\\n') END")


def indent(text) -> str:
    lead = f"substring({text}, 1, (length({text}) - length(ltrim({text}, {WS})))::BIGINT)"
    return (f"(CASE WHEN {trim(text)} = '' THEN 0 ELSE length({lead}) + 3 * (length({lead}) - "
            f"length(replace({lead}, chr(9), ''))) END)::INT")


def file_columns(path="path") -> str:
    low = f"lower({path})"
    test = f"({has(low, fixed.TEST_PATH_PARTS)} OR {ends(low, fixed.TEST_PATH_ENDS)})"
    return f"lower({rxg(path, '[^/][.]([^./]+)$', 1)}) AS ext, {test} AS is_test"


def kind(path="path") -> str:
    name = f"list_extract(string_split({path}, '/'), -1)"
    return (f"CASE WHEN {inn(name, fixed.DEPENDENCY_FILES)} THEN 'Dependency' "
            f"WHEN {inn(name, fixed.CONFIG_FILES)} OR {starts(name, fixed.CONFIG_PREFIXES)} THEN 'Config' "
            f"WHEN {inn('ext', fixed.SOURCE_EXTENSIONS)} THEN 'Source' END")


def skipped(path="path") -> str:
    dirs = f"list_slice(string_split({path}, '/'), 1, -2)"
    return f"(len(list_filter({dirs}, lambda d: {inn('d', fixed.SKIP_DIRS)} OR starts_with(d, '.'))) > 0)"


def lang_case(table, build, default, ext="ext") -> str:
    langs = {}
    for names, entry in table:
        for name in names.split():
            langs.setdefault(name, []).append(entry)
    return f"CASE {ext} " + " ".join(f"WHEN {q(n)} THEN {build(es)}" for n, es in langs.items()) + f" ELSE {default} END"


def _filled(templates):
    var = f"list_extract({ql(derived.VARIABLES)}, ((doc_id + i // 4) % {len(derived.VARIABLES)})::INT + 1)"
    line = f"list_extract({templates}, ((doc_id * 7 + i) % len({templates}))::INT + 1)"
    return f"replace(replace({line}, '{{v}}', {var}), '{{t}}', piece)"


def _code_files():
    exts = f"list_extract({ql(derived.EXTENSIONS)}, (doc_id % {len(derived.EXTENSIONS)})::INT + 1)"
    tmpl = case_of("lang", {e: ql(ls) for e, ls in derived.code_templates().items()}, "NULL")
    path = """CASE doc_id % 20
      WHEN 3 THEN '/src/tests/f' || doc_id || '.' || lang WHEN 13 THEN '/src/test_f' || doc_id || '.' || lang
      WHEN 7 THEN '/node_modules/lib/f' || doc_id || '.' || lang WHEN 11 THEN '/.cache/f' || doc_id || '.' || lang
      WHEN 15 THEN '/web/f' || doc_id || '.min.js' WHEN 17 THEN '/conf/f' || doc_id || '/.env.local'
      WHEN 18 THEN '/conf/f' || doc_id || '/settings.py' WHEN 19 THEN '/deps/f' || doc_id || '/package.json'
      WHEN 14 THEN '/doc/f' || doc_id || '.TXT'
      ELSE '/src/m' || (doc_id % 5) || '/f' || doc_id || '.' || lang END"""
    return f"""
    code_docs AS (SELECT doc_id, source, text, {exts} AS lang, string_split(text, chr(10)) AS pieces FROM documents),
    code_tmpl AS (SELECT *, {tmpl} AS tmpl FROM code_docs),
    code_pieces AS (SELECT doc_id, source, text, lang, tmpl, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS i
                    FROM code_tmpl),
    code_text AS (SELECT doc_id, any_value(source) AS repo, any_value({path}) AS path,
                    string_agg({_filled('tmpl')}, chr(10) ORDER BY i) || chr(10) || any_value(text) AS content FROM code_pieces GROUP BY doc_id),
    corpus AS (SELECT repo, path, content, strlen(content) AS size, {file_columns()} FROM code_text)"""


def _iac_files():
    name = f"list_extract({ql(derived.IAC_NAMES)}, (doc_id % {len(derived.IAC_NAMES)})::INT + 1)"
    return f"""
    iac_pieces AS (SELECT doc_id, source, text, {ql(derived.iac_templates())} AS tmpl, unnest(string_split(text, chr(10))) AS piece,
                   unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
    iac_corpus AS (SELECT any_value(source) AS repo, '/ops/' || doc_id || '/' || any_value({name}) AS path,
                   string_agg({_filled('tmpl')}, chr(10) ORDER BY i) || chr(10) || any_value(text) AS content FROM iac_pieces GROUP BY doc_id)"""


def _manifests():
    n = len(derived.MANIFEST_NAMES)
    line = case_of("name", {m: f"replace({q(derived.MANIFEST_LINES[m])}, '{{p}}', list_extract("
                               f"{ql(derived.PACKAGES[m])}, (k % 7)::INT + 1))" for m in derived.MANIFEST_NAMES}, "''")
    return f"""
    man_parts AS (SELECT p_partkey AS k, p_size AS s, p_partkey // {derived.PARTS_PER_MANIFEST} AS grp,
      list_extract({ql(derived.MANIFEST_NAMES)}, ((p_partkey // {derived.PARTS_PER_MANIFEST}) % {n})::INT + 1) AS name
      FROM part),
    man_lines AS (SELECT grp, name, k, replace(replace(replace({line}, '{{x}}', (s % 10)::VARCHAR), '{{y}}',
      (k % 20)::VARCHAR), '{{z}}', (k % 7)::VARCHAR) AS line FROM man_parts),
    manifests AS (SELECT 'parts' AS repo, '/deps/' || grp || '/' || name AS path, name,
      string_agg(line, chr(10) ORDER BY k) AS content FROM man_lines GROUP BY grp, name)"""


NATURAL = f"""
    natural_files AS (
      SELECT source AS repo, '/documents/' || doc_id || '.txt' AS path, text AS content FROM documents
      UNION ALL SELECT role, '/conversations/' || conv_id || '-' || turn || '.txt', text FROM conversations
      UNION ALL SELECT 'pages', '/pages/' || page_id || '.html', html FROM pages
      UNION ALL SELECT 'benchmark', '/benchmark/' || item_id || '.txt', text FROM benchmark),
    nat AS (SELECT repo, path, content, strlen(content) AS size, {file_columns()} FROM natural_files),
    natural_lines AS (SELECT repo, path, ext, unnest(lines) AS text, unnest(range(1, len(lines) + 1)) AS line_no
      FROM (SELECT *, {lines_list('content')} AS lines FROM nat))"""

SOURCES = f"""
    sources AS (SELECT repo, path, ext, is_test, content FROM corpus
      WHERE {kind()} = 'Source' AND NOT {skipped()}
      AND NOT {has('lower(path)', fixed.MINIFIED_MARKS)}),
    lines AS (SELECT repo, path, ext, is_test, unnest(lines) AS text, unnest(range(1, len(lines) + 1)) AS line_no
      FROM (SELECT *, {lines_list('content')} AS lines FROM sources))"""

MARK = (f"CASE WHEN contains(text, '*/') THEN 'C' WHEN starts_with({trim('text')}, '/*') THEN 'O' END")
COMMENTS = f"""
    marked AS (SELECT *, {MARK} AS mark FROM lines),
    masked AS (SELECT * EXCLUDE (mark), (coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY repo, path
      ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'O', false)
      OR {starts(trim('text'), fixed.COMMENT_STARTS + ['/*'])}) AS is_comment FROM marked)"""


def false_source():
    """On a line table that carries p1..p3, the three trimmed lines above."""
    def dec(k):
        return f"coalesce({starts(f'p{k}', flows.FIXTURE_DECORATORS)}, false)"

    def cont(k):
        return f"coalesce(p{k} = '' OR right(p{k}, 1) IN (',', '(', chr(92)), false)"

    body = trim("text")
    literal = " OR ".join(rx(body, p) for p in flows.LITERAL_SIDES)
    return (f"({starts(body, flows.PARAM_DECORATORS)} OR {has(body, flows.DICT_VIEWS)} OR {literal} OR {dec(1)} "
            f"OR ({cont(1)} AND {dec(2)}) OR ({cont(1)} AND {cont(2)} AND {dec(3)}))")


ABOVE = ", ".join(f"lag({trim('text')}, {k}) OVER (PARTITION BY repo, path ORDER BY line_no) AS p{k}" for k in (1, 2, 3))


def sources_cte(name, catalog):
    def build(entries):
        return "[" + ", ".join(
            f"CASE WHEN {rxg('text', p, 1)} <> '' THEN {{'variable': {rxg('text', p, 1)}, 'source_type': {q(k)}}} END"
            for k, p in entries) + "]"
    table = [(langs, (k, p)) for k, langs, p in catalog]
    return f"""
    {name}_near AS (SELECT repo, path, ext, is_test, line_no, text, {ABOVE} FROM lines),
    {name} AS (SELECT repo, path, ext, is_test, line_no, text, s.variable AS variable, s.source_type AS source_type
      FROM (SELECT *, unnest(list_filter({lang_case(table, build, '[]')}, lambda x: x IS NOT NULL)) AS s
      FROM {name}_near WHERE NOT {false_source()}))"""


SAFE = (f"(({has('lower(text)', flows.SHELL_OFF)} AND {has('lower(text)', flows.LIST_CALLS)}) "
        f"OR {has('lower(text)', flows.DICT_VIEWS)})")


def sinks_cte(name, catalog):
    """catalog rows: sink type, languages, severity, cwe, pattern."""
    def build(entries):
        items = []
        for rank, k, sev, cwe, p in entries:
            test = rx("text", p) + (f" AND NOT {SAFE}" if k == "command_execution" else "")
            items.append(f"CASE WHEN {test} THEN {{'sink_type': {q(k)}, 'severity': {q(sev)}, 'cwe': {q(cwe)}, "
                         f"'rank': {rank}}} END")
        return "[" + ", ".join(items) + "]"
    table = [(langs, (i, k, sev, cwe, p)) for i, (k, langs, sev, cwe, p) in enumerate(catalog)]
    return f"""
    {name} AS (SELECT repo, path, ext, is_test, line_no, text, k.sink_type AS sink_type, k.severity AS sink_severity,
      k.cwe AS cwe, k.rank AS rank FROM (SELECT *, unnest(list_filter({lang_case(table, build, '[]')},
      lambda x: x IS NOT NULL)) AS k FROM lines))"""


def _fn_name():
    def name(p):
        one = f"nullif({rxg('text', p, 1)}, '')"
        return f"coalesce({one}, nullif({rxg('text', p, 2)}, ''))" if p.count(r"(\w+)") > 1 else one
    return lang_case(list(flows.FUNCTION_HEADERS.items()), lambda es: name(es[0]), name(flows.FUNCTION_HEADER_ELSE))


HEADS = f"""
    measured AS (SELECT repo, path, line_no, text, ext, {indent('text')} AS indent, {_fn_name()} AS fn FROM lines),
    fn_heads AS (SELECT repo, path, line_no, indent, fn AS name,
      ({rx('text', flows.TEST_MARK)} OR {rx('fn', flows.TEST_MARK)}) AS is_test FROM measured WHERE fn IS NOT NULL),
    cl_heads AS (SELECT repo, path, line_no, indent, {rxg('text', flows.CLASS_HEADER, 1)} AS name
      FROM measured WHERE {rx('text', flows.CLASS_HEADER)})"""


def with_(*parts, final):
    return "WITH " + ",".join(p.strip() for p in parts) + "\n" + final.strip()


CODE, IAC, MANIFESTS = _code_files(), _iac_files(), _manifests()
