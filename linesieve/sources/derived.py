"""Code, configuration, manifest and graph tables derived from the given tables.

The given tables hold prose, so the code scanners get a corpus built from
``documents``: one file per document, first one code line per document line,
then the whole text of the document. A template is picked by arithmetic on the
document id and line number. The same arithmetic is written in SQL for the
oracle, from the same templates.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesieve.catalog import examples
from linesieve.catalog.composite import COMPOSITE_RULES
from linesieve.catalog.rules import RULES
from linesieve.functions.text import case_of, q, settle
from linesieve.sources.corpus import corpus_from_table

EXTENSIONS = ("py js java c go php rb ts cs rs cpp kt jsx swift sh sol tsx xml html h erb m bash kts").split()
VARIABLES = ["alpha", "beta", "gamma"]

# Little programs per language family, so that sources, assignments, guards and
# sinks follow one another; {v} is the variable of the place, {t} the text.
PROGRAMS = {
    "py": [
        "class Handler:", "    def view(request, {v}):", "        {v} = request.args['q']", "        {t}",
        "        cursor.execute(f'SELECT {v}')", "        requests.get(url_{v})",
        "        copy_{v} = {v} + '!'", "        try:", "            cursor.execute('SELECT ' + copy_{v})",
        "        for row in rows:", "            os.system({v})", "", "@pytest.mark.parametrize('x', [",
        "    {v} = request.form", "def test_{v}():", "    {v} = input()", "    {v} = shlex.quote({v})",
        "    subprocess.call({v})", "# {v} = request.args", "{v} = 'constant'", "{v} = sys.argv", "open({v})",
        "clean_{v} = validate({v})", "eval(clean_{v})", "\t{v} = os.environ.get('A')", "\teval({v})",
        "/* open", "cursor.execute(f'{v}')", "*/ closed", "{t}", "log.info({v})", "subprocess.run([{v}], shell=False)"],
    "js ts jsx tsx": [
        "app.get('/x', function handler(req, res) {", "  const {v} = req.query;", "  {t}", "  let next_{v} = {v};",
        "  db.query('SELECT ' + next_{v});", "}", "", "describe('suite', function test_it() {",
        "  const {v} = req.body;", "  fetch({v});", "/*", " eval({v});", " */", "// eval({v})",
        "class View {", "  for (const a of {v}) {", "    document.write({v});", "  const {v} = DOMPurify.sanitize({v});",
        "  el.innerHTML = {v};", "  const {v} = location.hash;", "  let b = encodeURIComponent({v});",
        "  window.location = b;", "  const {v} = process.env;", "  child_process.exec({v});", "{t}"],
    "java kt kts": [
        "public class Service {", "  @GetMapping(\"/x\")", "  public String load(String id) {",
        "    em.createQuery(\"x\" + {v});", "    String {v} = request.getParameter(\"q\");",
        "    {t}", "    String copy = {v};", "    stmt.execute(copy);", "    try {", "      logger.info({v});", "    }",
        "  }", "", "  @Test", "  public void testLoad() {", "    String {v} = request.getHeader(\"h\");",
        "    new FileInputStream({v});", "  /* note", "  stmt.execute({v});", "  */", "  PreparedStatement p = c.prepare({v});",
        "  ctx.search({v}, PreparedStatement);", "{t}"],
    "c cpp h": [
        "int main(int argc, char **argv) {", "  fgets({v}, 10, stdin);", "  {t}", "  char *q = {v};",
        "  system(q);", "  free({v});", "  printf({v});", "  free({v});", "  return 0;", "}", "",
        "  free({v});", "  {v} = NULL;", "  char *p = malloc(8);", "  if (p == NULL) return 1;",
        "  q = malloc(9);", "  x++;", "  y++;", "  z++;", "/* {v} */", "  free({v});", "  // {v}", "}", "{t}",
        "  while (1) {", "    popen({v}, \"r\");", "  if (limit > MAX_SIZE) fopen({v});"],
    "go": [
        "func handler(w http.ResponseWriter, r *http.Request) {", "  {v} := r.FormValue(\"q\")", "  {t}",
        "  copied := {v}", "  db.Query(copied)", "}", "", "func TestX(t *testing.T) {", "  {v} := os.Getenv(\"A\")",
        "  exec.Command({v})", "  clean := filepath.Clean({v})", "  os.Open(clean)", "-- note", "{t}"],
    "php": [
        "function view() {", "  ${v} = $_GET['q'];", "  {t}", "  $copy = ${v};", "  execute($copy);", "}", "",
        "  ${v} = htmlspecialchars(${v});", "  eval(${v});", "  system(escapeshellarg(${v}));", ";; note", "{t}"],
    "rb erb": [
        "class Page", "  def show", "    {v} = params[:q]", "    {t}", "    copy = {v}", "    query(copy)",
        "    begin", "      system({v})", "    end", "", "  def test_show", "    {v} = params[:z]",
        "    File.open(File.basename({v}))", "    logger.info({v})", "{t}"],
    "cs": [
        "public class Page {", "  public void Load() {", "    var {v} = Request.Query[\"q\"];", "    {t}",
        "    var copy = {v};", "    Process.Start(copy);", "    Response.Write({v});", "  }", "",
        "    string {v} = context.Request;", "    cmd.Execute(SqlParameter, {v});", "{t}"],
    "rs": [
        "pub fn run() {", "  let {v} = std::env::args();", "  {t}", "  let copy = {v};", "  Command::new(copy);", "}",
        "", "  fs::read({v});", "#[test]", "fn test_run() {", "  let mut {v} = req.body;", "  File::open({v});", "{t}"],
    "swift m sh bash sol xml html": ["{t}", "function run() {", "  {v}=1", "}", ""],
}

IAC_NAMES = ["svc/Dockerfile", "docker-compose.yml", "infra/main.tf", "k8s/deploy.yaml", ".github/workflows/ci.yml",
             "etc/nginx.conf", "chart/values.yaml", "bin/run.sh", "app/AndroidManifest.xml", "infra/policy.json",
             "Dockerfile.md", "infra/prod.tfvars", "Jenkinsfile", "Makefile"]
IAC_EXTRA = [
    "{t}", "USER app", "USER root", "HEALTHCHECK CMD true", "apiVersion: v1", "kind: Deployment", "containers:",
    "resources:", "kind: NetworkPolicy", 'resource "aws_s3_bucket" "b" {', "versioning {", "server_side_encryption {",
    "FROM scratch:latest AS base", 'password = "placeholder"', "", "# privileged: true"]

MANIFEST_NAMES = ["package.json", "requirements.txt", "pom.xml", "build.gradle", "go.mod", "Gemfile", "Cargo.toml",
                  "package-lock.json", "composer.json", "mix.exs"]
PACKAGES = {
    "package.json": ["lodash", "minimist", "left-pad", "express", "axios", "@scope/tar", "semver"],
    "requirements.txt": ["Django", "flask", "requests", "numpy", "PyYAML", "django-extensions", "jinja2"],
    "pom.xml": ["log4j-core", "gson", "guava", "snakeyaml", "commons-io", "commons-text", "junit"],
    "build.gradle": ["log4j-core", "gson", "guava", "snakeyaml", "commons-io", "commons-text", "junit"],
    "go.mod": ["golang.org/x/crypto", "golang.org/x/net", "example.com/a", "github.com/gin-gonic/gin",
               "example.com/b", "golang.org/x/text", "example.com/mysql"],
    "Gemfile": ["rails", "nokogiri", "rack", "puma", "rack-test", "rake", "redis"],
    "Cargo.toml": ["hyper", "h2", "serde", "hyper-tls", "tokio", "rand", "h2-sys"],
    "package-lock.json": ["lodash", "minimist", "left-pad", "express", "axios", "underscore", "semver"],
    "composer.json": ["a/rails", "b/c", "d/e", "f/g", "h/i", "j/k", "l/m"],
    "mix.exs": ["phoenix", "ecto", "plug", "jason", "redis", "mongodb", "telnet://host"],
}
MANIFEST_LINES = {
    "package.json": '  "{p}": "^{x}.{y}.{z}",',
    "requirements.txt": "{p}=={x}.{y}.{z}",
    "pom.xml": "<dependency><artifactId>{p}</artifactId><version>{x}.{y}.{z}</version></dependency>",
    "build.gradle": "implementation 'org.g:{p}:{x}.{y}.{z}'",
    "go.mod": "    {p} v{x}.{y}.{z}",
    "Gemfile": "gem '{p}', '~> {x}.{y}.{z}'",
    "Cargo.toml": '{p} = "{x}.{y}.{z}"',
    "package-lock.json": '"{p}": { "version": "{x}.{y}.{z}" },',
    "composer.json": '"{p}": "^{x}.{y}.{z}",',
    "mix.exs": "{p} mysql {x}.{y}.{z}",
}
PARTS_PER_MANIFEST = 10

NODE_TYPES = ["Source", "Assignment", "FunctionCall", "Return", "Sanitizer", "Sink", "Parameter"]


def code_templates() -> dict:
    """extension -> templates: the family's program, then the rule examples."""
    rule_langs = {r[0]: r[4].split() for r in RULES}
    comp_langs = {r[0]: r[5].split() for r in COMPOSITE_RULES}
    hits = [(rule_langs[i], line) for i, line in examples.parse(examples.RULE_EXAMPLES)]
    hits += [(comp_langs[i], line) for i, line in examples.parse(examples.COMPOSITE_EXAMPLES)]
    program = {e: lines for names, lines in PROGRAMS.items() for e in names.split()}
    credentials = list(examples.credential_lines().values())
    return {e: program[e] + [line for langs, line in hits if e in langs] + credentials for e in EXTENSIONS}


def iac_templates() -> list:
    return [line for _, line in examples.parse(examples.IAC_EXAMPLES)] + IAC_EXTRA


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as its splits come; only one with fewer splits than there are cores is dealt out evenly.

    The small given files can hold all their rows in one split, which one core would scan. A table
    that fills the cores is not shuffled.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def string_array(values) -> str:
    return f"array({', '.join(q(v) for v in values)})"


def filled(text, templates, doc_id) -> str:
    """For line k of a document template (7 * id + k) mod N, slots filled; then the text itself."""
    pieces = f"split({text}, {q(chr(10))})"
    variable = f"get({string_array(VARIABLES)}, CAST(({doc_id} + (i + 1) DIV 4) % {len(VARIABLES)} AS int))"
    line = f"get({templates}, CAST(({doc_id} * 7 + i + 1) % size({templates}) AS int))"
    return (f"concat(array_join(transform({pieces}, (t, i) -> "
            f"replace(replace({line}, '{{v}}', {variable}), '{{t}}', t)), {q(chr(10))}), {q(chr(10))}, {text})")


def code_path(doc_id, ext) -> str:
    """Mostly plain sources; tests, skipped, hidden, minified, config and
    dependency paths in between."""
    arms = " ".join(f"WHEN {slot} THEN concat({before}, 'f', {doc_id}, {after})" for slot, (before, after) in {
        3: ("'/src/tests/'", f"'.', {ext}"), 13: ("'/src/test_'", f"'.', {ext}"),
        7: ("'/node_modules/lib/'", f"'.', {ext}"), 11: ("'/.cache/'", f"'.', {ext}"),
        15: ("'/web/'", "'.min.js'"), 17: ("'/conf/'", "'/.env.local'"), 18: ("'/conf/'", "'/settings.py'"),
        19: ("'/deps/'", "'/package.json'"), 14: ("'/doc/'", "'.TXT'")}.items())
    return f"CASE {doc_id} % 20 {arms} ELSE concat('/src/m', {doc_id} % 5, '/f', {doc_id}, '.', {ext}) END"


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One code file per document, with its whole text."""
    docs = read_table(spark, sf_dir, "documents")
    kinds = code_templates()
    templates = case_of("lang", {e: string_array(kinds[e]) for e in EXTENSIONS}, "NULL")
    base = settle(docs.select("doc_id", "source", "text"), ["doc_id", "source", "text"], {
        "lang": f"get({string_array(EXTENSIONS)}, CAST(doc_id % {len(EXTENSIONS)} AS int))"})
    rows = settle(base.selectExpr("doc_id", "source", "lang", "text", f"{templates} AS templates"),
                  ["source"], {"file": code_path("doc_id", "lang"), "code": filled("text", "templates", "doc_id")})
    return corpus_from_table(rows, "source", "file", "code")


def iac_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configuration file per document, with its whole text."""
    docs = read_table(spark, sf_dir, "documents")
    name = f"get({string_array(IAC_NAMES)}, CAST(doc_id % {len(IAC_NAMES)} AS int))"
    rows = settle(docs.selectExpr("doc_id", "source", "text", f"{string_array(iac_templates())} AS templates"), ["source"], {
        "file": f"concat('/ops/', doc_id, '/', {name})", "config": filled("text", "templates", "doc_id")})
    return corpus_from_table(rows, "source", "file", "config")


def manifest_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests from ``part``: ten parts each, a package and version per part."""
    part = read_table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS k", "p_size AS s", f"p_partkey DIV {PARTS_PER_MANIFEST} AS grp")
    name = f"get({string_array(MANIFEST_NAMES)}, CAST(grp % {len(MANIFEST_NAMES)} AS int))"
    line = case_of("name", {n: f"replace({q(MANIFEST_LINES[n])}, '{{p}}', "
                            f"get({string_array(PACKAGES[n])}, CAST(k % 7 AS int)))" for n in MANIFEST_NAMES}, "''")
    for slot, value in (("{x}", "s % 10"), ("{y}", "k % 20"), ("{z}", "k % 7")):
        line = f"replace({line}, '{slot}', CAST({value} AS string))"
    rows = part.selectExpr("*", f"{name} AS name").selectExpr("grp", "name", "k", f"{line} AS line")
    # PARTS_PER_MANIFEST keys fall in a group, which bounds the list
    files = rows.groupBy("grp", "name").agg(F.expr(
        f"array_join(transform(array_sort(collect_list(struct(k, line))), p -> p.line), {q(chr(10))})").alias("text"))
    return corpus_from_table(files, "'parts'", "concat('/deps/', grp, '/', name)", "text")


def natural_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, conversations, pages and benchmark items as files."""
    def files(name, repo, path, text):
        return corpus_from_table(read_table(spark, sf_dir, name), repo, path, text)

    return (files("documents", "source", "concat('/documents/', doc_id, '.txt')", "text")
            .unionByName(files("conversations", "role", "concat('/conversations/', conv_id, '-', turn, '.txt')", "text"))
            .unionByName(files("pages", "'pages'", "concat('/pages/', page_id, '.html')", "html"))
            .unionByName(files("benchmark", "'benchmark'", "concat('/benchmark/', item_id, '.txt')", "text")))


def flow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = f"get({string_array(NODE_TYPES)}, CAST(event_id % {len(NODE_TYPES)} AS int))"
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", f"{kind} AS node_type", "concat('/u/', user_id) AS path")


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events plus skips of three, five and a few back edges."""
    ids = read_table(spark, sf_dir, "events").selectExpr("event_id AS src")
    steps = ("filter(array(1, IF(src % 4 = 0, 3, NULL), IF(src % 6 = 0, 5, NULL), IF(src % 9 = 0, -2, NULL)), "
             "s -> s IS NOT NULL)")
    edges = ids.selectExpr("src", f"explode({steps}) AS step").selectExpr("src", "src + step AS dst")
    return edges.join(ids.selectExpr("src AS dst"), "dst", "left_semi").select("src", "dst")
