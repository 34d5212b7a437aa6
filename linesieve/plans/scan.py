"""A whole scan: every result table of a corpus."""

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.catalog.secrets import HIDDEN_ONLY
from linesieve.functions.shared import written
from linesieve.functions.text import settle
from linesieve.operators import chains as chain_ops
from linesieve.operators import composite, deps, flow, iac, patterns, post, secrets, summary, taint
from linesieve.operators.files import collect_files, drop_tests, source_lines
from linesieve.operators.lines import FILE_COLUMNS
from linesieve.operators.near import with_near


class Kinds(Mapping):
    """Result tables by kind, each planned when it is first asked for."""

    def __init__(self, builders: dict):
        self._builders, self._built = builders, {}

    def __getitem__(self, kind):
        if kind not in self._built:
            self._built[kind] = self._builders[kind]()
        return self._built[kind]

    def replace(self, kind, table):
        self._built[kind] = table

    def __iter__(self):
        return iter(self._builders)

    def __len__(self):
        return len(self._builders)


class ScanResult:
    """The tables of a scan. Nothing runs until one is asked for.

    The text of the source files is read once: the first table that needs the facts writes them, a
    small part of the text, to the shared folder, and all others read them there. Deduplicated
    findings, taints and flows are written, too, when chains are asked for, which read each of them
    several times. So neither a later step nor a lost executor brings the read of the text back.
    """

    def __init__(self, corpus: DataFrame, include_tests: bool = False, min_severity: str | None = None,
                 iac_files: DataFrame | None = None):
        self.include_tests = include_tests
        self.collected = collect_files(corpus, include_tests=True)
        files = self.collected if include_tests else drop_tests(self.collected)
        config = files.filter("kind = 'Config'")
        self._files = files
        builders = {
            "pattern": lambda: post.finding_dedupe(patterns.uncovered_findings(self.facts)),
            "composite": lambda: composite.composite_scan(self.facts),
            "taint": lambda: self._tables["taint"] if "taint" in self._tables else taint.taint_findings(self.facts),
            "flow": lambda: self._tables["flow"] if "flow" in self._tables else flow.flow_paths(self.facts),
            "secret": lambda: secrets.secret_dedupe(secrets.redact(
                secrets.secrets_of(self.facts).unionByName(secrets.secret_scan(config)), more=HIDDEN_ONLY)).drop("text"),
            "dependency": lambda: deps.dep_findings(files.filter("kind = 'Dependency'")),
            "iac": lambda: iac.iac_findings(config if iac_files is None else iac_files),
            "chain": lambda: chain_ops.all_chains(*[self._table(name) for name in ("finding", "taint", "flow")]),
        }
        self._tables = {}
        graded = {kind: (lambda b=b: post.min_severity(b(), min_severity)) if min_severity else b for kind, b in builders.items()}
        self.found = Kinds(graded)
        self.kinds = Kinds({kind: (lambda kind=kind: without_credentials(kind, self.found[kind])) for kind in builders})

    @cached_property
    def facts(self) -> DataFrame:
        return written(source_facts(source_lines(self._files)))

    def _table(self, name: str) -> DataFrame:
        if name not in self._tables:
            made = {"finding": lambda: post.finding_dedupe(patterns.all_findings(self.facts)),
                    "taint": lambda: taint.taint_findings(self.facts), "flow": lambda: flow.flow_paths(self.facts)}[name]()
            self._tables[name] = written(made)
        return self._tables[name]

    def keep(self) -> "ScanResult":
        """Writes every table that is not yet, for a result that reads them more than once."""
        self.found["chain"]
        for kind in self.found:
            if kind not in self._tables:
                self.found.replace(kind, written(self.found[kind]))
        return self

    def summary(self) -> DataFrame:
        """Counts per repo. The chains' tables come first, so that the counts read the written ones."""
        self.found["chain"]
        return summary.scan_summary(summary.scanned(self.collected, self.include_tests), self.found)


#: Text columns and text arrays of a kind that hold lines of a file.
LINE_TEXTS = {
    "pattern": (["text", "matched_text"], ["context_before", "context_after"]), "composite": (["text"], []),
    "iac": (["text"], []), "dependency": (["package_name"], []), "taint": (["source_text", "sink_text", "sanitizer_info"], []),
    "flow": (["sink_text"], ["step_texts"])}


def without_credentials(kind: str, rows: DataFrame) -> DataFrame:
    """The rows of a kind with hidden credentials, in the same columns."""
    if kind not in LINE_TEXTS:
        return rows
    columns = rows.columns
    if kind == "taint":
        rows = rows.selectExpr("*", "source.text AS source_text", "sink.text AS sink_text")
    if kind == "flow":
        rows = rows.selectExpr("*", "transform(steps, s -> s.text) AS step_texts")
    rows = secrets.hide_secrets(rows, *LINE_TEXTS[kind])
    if kind == "taint":
        rows = rows.withColumn("source", F.col("source").withField("text", F.col("source_text")))
        rows = rows.withColumn("sink", F.col("sink").withField("text", F.col("sink_text")))
    if kind == "flow":
        rows = rows.withColumn("steps", F.expr(
            "transform(steps, (s, i) -> named_struct('line_no', s.line_no, 'step', s.step, 'variable', s.variable, 'text', step_texts[i]))"))
    return rows.select(*columns)


def source_facts(files: DataFrame) -> DataFrame:
    """Everything the source scanners need of a file, in one read of its text.

    The pass is narrow: the lines become an array in the row, and what comes out
    are the few lines that some catalog has an interest in. Files without any
    drop out. Credentials are looked for first; what any other scanner sees, and so any text or
    context that leaves the row, has the lines of a credential over several lines hidden. The words
    that the catalogs ask for are looked up before all that, in the lines as they are.
    """
    near = with_near(files, {"secret": secrets.secret_words(), "rule": patterns.rule_words(), "held": composite.entry_words(),
                             "guard": composite.guard_words(), "context": composite.context_words(),
                             **taint.words(), **flow.words()})
    files = settle(near, [*FILE_COLUMNS, "near"], {
        "lines": secrets.masked_blocks("lines"), "secret_lines": secrets.secret_lines("near.secret")})
    seeded = settle(files, [*FILE_COLUMNS, "lines", "near", "secret_lines"], {
        **patterns.line_marks(), **taint.seeds(near=True), **flow.seeds(near=True)})
    facts = settle(seeded, [*FILE_COLUMNS, "lines", "scope_ends", "secret_lines", "taint_sources", "flow_sources"], {
        "candidates": patterns.candidates(near="near.rule"), "pointer_events": patterns.pointer_events(),
        "held": composite.held_rules(None, "near.held", "near.guard", "near.context"), **taint.reached(near=True), **flow.reached(near=True)})
    sizes = ["candidates", "pointer_events", "held", "secret_lines", "taint_sources", "flow_sources"]
    some = facts.filter(" OR ".join(f"size({c}) > 0" for c in sizes))
    kept = [c for c in facts.columns if c not in (*FILE_COLUMNS, "lines", "scope_ends")]
    return patterns.judged(patterns.with_free_scan(some, kept))


def scan(corpus: DataFrame, include_tests: bool = False, min_severity: str | None = None,
         iac_files: DataFrame | None = None) -> ScanResult:
    """Result tables per kind, each planned when it is asked for; see ``ScanResult``.

    Configuration rules look at files of kind Config; pass ``iac_files`` to apply them to another selection.
    """
    return ScanResult(corpus, include_tests, min_severity, iac_files)
