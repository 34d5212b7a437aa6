"""Lines near a catalog: what the automaton lets through, and tables that are read once."""

import pyarrow as pa

from linesieve.catalog import examples
from linesieve.catalog.rules import RULES
from linesieve.operators import composite, secrets, summary
from linesieve.operators.near import ANY_LANGUAGE, near_lines, with_near, words_by_language

LINES = ["API_KEY = 'x'", "plain prose", "", "toKen = 1", "tokİ", "pass word", "a.tokenizer(x)", None]


def test_near_lines_hold_a_word_in_either_case():
    words = {"a": {ANY_LANGUAGE: ["api_key", "token"]}, "b": {"py": ["(x"], "go": None}, "c": {"*": ["prose"], "py": []}}
    got = near_lines(pa.array(LINES), "py", words)
    assert got["a"].tolist() == [True, False, False, True, True, False, True, False]
    assert got["b"].tolist() == [False, False, False, False, True, False, True, False]
    assert not got["c"].any() and near_lines(pa.array(LINES), "go", words)["b"].all()
    assert near_lines(pa.array(LINES), "rb", words)["c"].tolist()[1]


def test_near_numbers_the_lines_of_each_file(spark):
    rows = [("r", "a", ["x", "token", "Token"]), ("r", "b", []), ("r", "c", None), ("r", "d", ["token"])]
    files = spark.createDataFrame(rows, "repo string, path string, lines array<string>")
    near = with_near(files, {"w": words_by_language([("", ["token"])])}, ext=None)
    assert {r.path: r.near and r.near.w for r in near.collect()} == {"a": [2, 3], "b": [], "c": None, "d": [1]}


def test_every_line_that_a_rule_meets_is_near():
    rules = {}
    for rule in RULES:
        rules.setdefault(rule[0], []).append(rule[6])
    for rule_id, line in examples.parse(examples.RULE_EXAMPLES):
        words = {"w": words_by_language([("", [p for p in rules[rule_id] if p])])}
        assert near_lines(pa.array([line, line.upper()]), "x", words)["w"].all(), rule_id
    assert all(w == w.lower() for own in composite.entry_words().values() for w in own or ())


def test_the_facts_ask_for_words_outside_of_the_row(spark):
    from linesieve.operators.files import split_files
    from linesieve.plans.scan import source_facts
    files = split_files(spark.createDataFrame([("r", "a.py", "py", False, "eval(x)\npassword = 'abcdefgh1234'")],
                                              "repo string, path string, ext string, is_test boolean, content string"))
    plan = source_facts(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Exchange" not in plan


def test_the_risk_label_reads_the_summary_once(spark):
    names = [*summary.TOTALS.values(), *[s.lower() for s in summary.SEVERITIES], "sanitized_flows"]
    rows = spark.createDataFrame([("a", *[0] * len(names)), ("b", *[1] * len(names)), (None, *[1] * len(names))],
                                 ", ".join(["repo string", *[f"{n} long" for n in names]]))
    got = summary.risk_label(rows)
    assert {r.repo: r.risk for r in got.collect()} == {"a": "NONE", "b": "CRITICAL"}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_hidden_arrays_cost_nothing_unless_asked_for(spark):
    rows = spark.createDataFrame([("password = 'abcdefgh1234'", ["password = 'abcdefgh1234'", "x"], None)],
                                 "text string, a array<string>, b array<string>")
    hidden = secrets.hide_secrets(rows, ["text"], ["a", "b"])
    row = hidden.first()
    assert "abcdefgh" not in str(row) and row.a[1] == "x" and row.b is None
    assert "hidden_lines" not in hidden.select("text")._jdf.queryExecution().optimizedPlan().toString()


def test_composite_rules_hold_alike_with_and_without_near_lines(spark):
    """Guards ten lines away, contexts above and blank lines between, asked of all lines and of the near ones."""
    from linesieve.functions.conditions import all_of, inside, leaf, none_near, not_inside
    rules = [("py", ("A", all_of(leaf(r"run\("), none_near(r"(?i)clean|safe")))),
             ("py", ("B", all_of(leaf(r"run\("), inside(r"def\s+\w+.*request")))),
             ("py js", ("C", all_of(leaf(r"run\("), not_inside(r"(?i)token"), none_near(all_of(leaf(r"(?i)guard"), inside(r"(?i)token")))))),
             ("js", ("D", all_of(leaf(r"go\("), none_near(r"x|y"))))]  # no word to ask for
    gap = ["pass"] * 9
    texts = [["def f(request):", "  run(1)", *gap, "CLEAN", *gap, "  run(2)", "", *gap, "run(3)", "Token", "run(4)", "guard"],
             ["run(1)", *gap, "\t ", *gap, "run(2)", *gap, "pass", "safe"], ["run(1)"], []]
    files = spark.createDataFrame([("r", f"{e}{i}", e, False, t) for e in ("py", "js", "go") for i, t in enumerate(texts + [["go(1)", "z", "go(2)", *gap, "", "Y"]])],
                                  "repo string, path string, ext string, is_test boolean, lines array<string>")
    near = with_near(files, {"held": composite.entry_words(rules), "guard": composite.guard_words(rules), "context": composite.context_words(rules)})
    plain, quick = composite.held_rules(rules), composite.held_rules(rules, "near.held", "near.guard", "near.context")
    got = near.selectExpr("path", f"{plain} AS plain", f"{quick} AS quick").collect()
    assert all(r.plain == r.quick for r in got)
    assert {x for r in got for h in r.plain for x in h.rules} == {"A", "B", "C", "D"}
    assert "guard" in composite.guard_words(rules)["py"] or "clean" in composite.guard_words(rules)["py"]


def test_tests_of_a_line_trim_its_head_only():
    """A trim of both ends reads the whole line; it was made once for each mark."""
    from linesieve.functions import text
    assert "BOTH" not in text.is_line_comment("t") + text.opens_block("t") + text.block_mark("t")
    assert "BOTH" not in composite.held_rules() + secrets.masked_blocks("lines")


def test_lines_are_lower_cased_once_for_all_rules():
    from linesieve.operators import taint
    assert secrets.found_rules("text").count("lower(") == 1
    catalog = [(kind, "py", "HIGH", "", kind + r"\(") for kind in ("run", "call", "open")]
    assert taint.find_sinks("lines", catalog, "near").count("lower(") == 2  # the words of all, the rules


def test_null_tests_are_asked_in_the_languages_of_their_rule(files_of):
    from linesieve.operators import patterns
    facts = patterns.pattern_facts(files_of({"a.c": "char *p = malloc(8);\nx = eval(y)\nif (p == NULL) return;"}))
    assert {c.null_tested for r in facts.collect() for c in r.candidates} == {True}
    assert patterns._null_tested("lines", "1", [("py", ("A", "eval"))]) == "false"
