import duckdb
import pytest

from linesieve.catalog import advisories, examples, flows
from linesieve.catalog.composite import COMPOSITE_RULES
from linesieve.catalog.iac import LINE_RULES
from linesieve.catalog.rules import RULES
from linesieve.catalog.secrets import SECRET_RULES
from linesieve.functions.keywords import keywords, worded
from linesieve.functions.text import matches, q
from linesieve.sources.derived import code_templates, iac_templates

PATTERNS = sorted(
    {r[6] for r in RULES if r[6]} | {p for r in COMPOSITE_RULES for p in r[8].patterns()}
    | {p for r in LINE_RULES for p in (r[6], r[7]) if p} | {r[3] for r in SECRET_RULES}
    | {s[-1] for t in (flows.TAINT_SOURCES, flows.TAINT_SINKS, flows.FLOW_SOURCES, flows.FLOW_SINKS,
                       flows.SANITIZERS, flows.FLOW_SANITIZERS) for s in t}
    | {p for e in advisories.EXTRACTORS.values() for p, _, _ in e} | {r[2] for r in advisories.RISKY_LINES}
    | set(flows.FUNCTION_HEADERS.values()) | {flows.CLASS_HEADER, flows.TRY_HEADER, flows.LOOP_HEADER})


def test_sizes_and_unique_rows():
    assert (len(RULES), len(COMPOSITE_RULES), len(LINE_RULES), len(advisories.ADVISORIES)) == (161, 44, 41, 39)
    assert len({(r[0], r[6]) for r in RULES}) == len(RULES)
    assert len({r[0] for r in RULES}) == 155
    assert len({r[0] for r in COMPOSITE_RULES}) == 44


def test_patterns_compile_in_both_engines_and_reject_empty_text(spark):
    row = spark.range(1).selectExpr(*[f"{matches(q(''), p)} AS c{i}" for i, p in enumerate(PATTERNS)]).first()
    assert not any(row)
    db = duckdb.connect()
    for p in PATTERNS:
        assert db.execute("SELECT regexp_matches('', ?)", [p]).fetchone() == (False,), p


@pytest.mark.parametrize("block, rules", [
    (examples.RULE_EXAMPLES, {r[0]: [x[6] for x in RULES if x[0] == r[0]] for r in RULES if r[6]}),
    (examples.IAC_EXAMPLES, {r[0]: [r[6]] for r in LINE_RULES}),
])
def test_every_rule_has_an_example_it_matches_and_harmless_lines_it_does_not(spark, block, rules):
    rows = [(i, line.replace("{v}", "alpha")) for i, line in examples.parse(block)]
    assert {i for i, _ in rows} == set(rules)
    harmless = ["", "the quick brown fox", "x = y", "}", "    call(a, b);"]
    df = spark.createDataFrame(rows, "rule string, line string")
    arms = " ".join(f"WHEN {q(i)} THEN {' OR '.join(matches('line', p) for p in ps)}" for i, ps in rules.items())
    assert df.filter(f"NOT CASE rule {arms} END").collect() == []
    calm = spark.createDataFrame([(h,) for h in harmless], "line string")
    every = " OR ".join(matches("line", p) for ps in rules.values() for p in ps)
    assert calm.filter(every).collect() == []


def test_a_match_always_holds_its_keywords(spark):
    lines = sorted({line.replace("{v}", v) for ts in [*code_templates().values(), iac_templates()] for line in ts
                    for v in ("alpha", "REQUEST")} | {line.upper() for line in iac_templates()})
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    known = [p for p in PATTERNS if keywords(p)]
    assert len(known) > 250
    for start in range(0, len(known), 60):
        cond = " OR ".join(f"({matches('line', p)} AND NOT {worded('line', [p])})" for p in known[start:start + 60])
        assert df.filter(cond).collect() == []


def test_keywords_of_typical_patterns():
    assert keywords(r"(?i)(?:exec|system)\s*\(") == {"exec", "system"}
    assert keywords(r"subprocess\.(?:call|run)") == {"subprocess.call", "subprocess.run"}
    assert keywords(r"\w+\s*=") is None
