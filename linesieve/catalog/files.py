"""File classes, skipped directories, limits and path marks."""

# The names, extensions, limits and marks below must equal the
# published lists for equal results.
SOURCE_EXTENSIONS = """
py pyw js jsx ts tsx mjs cjs java kt kts scala c h cpp hpp cc cxx hh hxx go rs
rb erb php phtml cs cshtml swift m mm sh bash zsh fish pl pm lua r hs ex exs
clj cljs dart html htm ejs hbs vue svelte xml yaml yml json toml ini cfg conf
dockerfile tf hcl sql sol
""".split()

DEPENDENCY_FILES = """
package.json package-lock.json yarn.lock pnpm-lock.yaml requirements.txt Pipfile
Pipfile.lock setup.py setup.cfg pyproject.toml pom.xml build.gradle
build.gradle.kts go.mod go.sum Gemfile Gemfile.lock Cargo.toml Cargo.lock
composer.json composer.lock mix.exs pubspec.yaml
""".split()

CONFIG_FILES = """
.env .env.local .env.production .env.staging .env.development .htaccess
nginx.conf httpd.conf apache2.conf docker-compose.yml docker-compose.yaml
Dockerfile .dockerignore .gitignore Makefile Jenkinsfile .travis.yml
.github/workflows serverless.yml terraform.tfvars web.config appsettings.json
config.yml config.yaml config.json settings.py settings.json
""".split()
CONFIG_PREFIXES = [".env", "Dockerfile"]

# Hidden directories are skipped too, so the dotted names are covered twice.
SKIP_DIRS = """
node_modules .git __pycache__ .tox .mypy_cache .pytest_cache target build dist
bin obj .gradle .mvn .idea .vscode .vs vendor venv .venv env .env .eggs
*.egg-info bower_components .next .nuxt .output coverage
""".split()

# Published limits, for callers that want them; nothing applies them by itself.
MAX_FILE_BYTES = 1048576
MAX_LINES = 50000
MINIFIED_MARKS = [".min.js", ".min.css", ".bundle.js"]

TEST_PATH_PARTS = [
    "/_tests/", "/tests/", "/test/", "/__tests__/", "/spec/", "/fixtures/",
    "/test-", "/testing/", "/test_",
]
TEST_PATH_ENDS = [
    "_test.py", "_test.go", "_test.rs", "_spec.rb", "_spec.js",
    ".test.js", ".test.ts", ".spec.ts",
]

COMMENT_STARTS = ["//", "#", "--", ";;"]

# Words that mark a line as a security control, and the rules they silence.
DEFENSIVE_WORDS = """
containsdotdot sanitize validate escape clean filter check verify guard protect
secure normalize canonicalize whitelist allowlist blocklist denylist blacklist
isvalid is_valid is_safe issafe isbad is_bad
""".split()
DEFENSIVE_RULES = """
GO-PATH-001 GO-INJ-001 GO-CMD-001 GO-SSRF-001 GO-TMPL-001 GO-REDIR-001
C-CMD-001 C-FMT-001 PHP-INJ-001 PHP-INJ-002 PHP-XSS-001 RB-INJ-001 RB-CMD-001
JS-FILE-001 JS-SSRF-001 JAVA-SEC-001 JAVA-SEC-002 RS-PATH-001 RS-CMD-001
CS-INJ-001 CS-CMD-001
""".split()
NULL_TEST_MARKS = ["== null", "!= null", "== 0", "!= 0", "if (", "if(", "== nullptr", "!= nullptr"]
NULLIFY_MARKS = ["= NULL", "= nullptr", "= 0"]
SCOPE_END_STARTS = ["return", "void ", "int ", "static ", "char ", "struct "]

SEVERITY_SCORES = {"CRITICAL": 10, "HIGH": 8, "MEDIUM": 5, "LOW": 3, "INFO": 1}
REPORT_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
REPORT_SCORES = {"CRITICAL": "9.5", "HIGH": "7.5", "MEDIUM": "5.0", "LOW": "2.5"}
