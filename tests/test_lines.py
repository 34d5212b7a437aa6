import random

from linesieve.functions import conditions
from linesieve.functions.text import extension, indent_width, is_test_path, q, relative_path, split_lines
from linesieve.operators import composite, lines, patterns
import models


def one(spark, expr):
    return spark.range(1).selectExpr(f"{expr} AS v").first().v


def test_split_lines(spark):
    cases = {"a\r\nb\n": ["a", "b"], "a\n\nb": ["a", "", "b"], "": [], "\n": [""], "a\r\n": ["a"], "a\n\n": ["a", ""]}
    for text, want in cases.items():
        assert one(spark, split_lines(q(text))) == want, text


def test_extension_and_paths(spark):
    cases = {"/a/b.PY": "py", "/a/.env": "", "/a/.env.local": "local", "/a.b/c": "", "/x.tar.gz": "gz", "f.py": "py"}
    for path, want in cases.items():
        assert one(spark, extension(q(path))) == want, path
    assert one(spark, is_test_path(q("/src/Tests/a.py")))
    assert one(spark, is_test_path(q("/src/a_test.go"))) and not one(spark, is_test_path(q("/src/contest.py")))
    assert one(spark, relative_path(q("/r//a.py"), "/r")) == "a.py"
    assert one(spark, relative_path(q("x/a.py"), "/r")) == "x/a.py"


def test_indent(spark):
    for text, want in {"  a": 2, "\ta": 4, " \t a": 6, "": 0, "   ": 0}.items():
        assert one(spark, indent_width(q(text))) == want


def comments(spark, texts):
    df = spark.createDataFrame([("r", str(i), "c", n + 1, t) for i, ls in enumerate(texts) for n, t in enumerate(ls)],
                               "repo string, path string, ext string, line_no int, text string")
    got = {}
    for r in lines.comment_mask(df).collect():
        got.setdefault(int(r.path), {})[r.line_no] = r.is_comment
    return [[got[i][n + 1] for n in range(len(ls))] for i, ls in enumerate(texts)]


PIECES = ["code();", "/* open", "close */", "/* both */", "// x", " # y", "-- z", ";; w", "", "a /* b", "*/", "/*/"]


def test_comment_mask_against_the_line_model(spark):
    rnd = random.Random(1)
    texts = [[rnd.choice(PIECES) for _ in range(rnd.randint(1, 30))] for _ in range(200)]
    assert comments(spark, texts) == [models.comment_lines(t) for t in texts]


def test_comment_mask_inside_the_pattern_scan(spark, files_of):
    rnd = random.Random(2)
    texts = [[rnd.choice(PIECES + ["setuid(0);"] * 4) for _ in range(rnd.randint(1, 30))] for _ in range(100)]
    facts = patterns.pattern_facts(files_of({f"/f{i}.c": "\n".join(t) + "\n" for i, t in enumerate(texts)}))
    got = {(r.path, r.line_no) for r in patterns.raw_matches(facts).filter("rule_id = 'C-SEC-001'").collect()}
    want = {(f"/f{i}.c", n + 1) for i, t in enumerate(texts) for n, c in enumerate(models.comment_lines(t))
            if not c and t[n] == "setuid(0);"}
    assert got == want


def held(files_of, texts, cond):
    facts = composite.composite_facts(files_of({f"/f{i}.py": "\n".join(t) + "\n" for i, t in enumerate(texts)}),
                                      [("py", ("R", cond))])
    return {(r.path, r.line_no) for r in composite.condition_hits(facts).collect()}


def test_conditions_against_the_line_model(spark, files_of):
    rnd = random.Random(3)
    texts = [[rnd.choice(["hit", "guard", "", "x", "x", "x", " ", "y"]) for _ in range(rnd.randint(1, 60))]
             for _ in range(200)]

    def places(test):
        return {(f"/f{i}.py", n + 1) for i, t in enumerate(texts) for n, line in enumerate(t) if line == "hit" and test(t, n)}

    hit = conditions.leaf("hit")
    assert held(files_of, texts, conditions.all_of(hit, conditions.none_near("guard"))) == places(
        lambda t, n: models.none_near(t, n, "guard"))
    inside = held(files_of, texts, conditions.all_of(hit, conditions.inside("guard")))
    assert inside == places(lambda t, n: models.inside(t, n, "guard"))
    outside = held(files_of, texts, conditions.all_of(hit, conditions.not_inside("guard")))
    assert outside == places(lambda t, n: True) - inside


def test_a_guard_over_a_tree_and_a_rule_without_a_pattern_of_its_own(spark, files_of):
    texts = [["hit", "a", "a b"], ["hit", "a", "b"]]
    both = conditions.none_near(conditions.all_of(conditions.leaf("a"), conditions.leaf("b")))
    assert held(files_of, texts, conditions.all_of(conditions.leaf("hit"), both)) == {("/f1.py", 1)}
    assert held(files_of, texts, conditions.inside("hit")) == {("/f0.py", 2), ("/f0.py", 3), ("/f1.py", 2), ("/f1.py", 3)}


def test_none_near_at_the_edge(files_of):
    cond = conditions.all_of(conditions.leaf("hit"), conditions.none_near("guard"))
    for gap, kept in ((10, False), (11, True)):
        after = ["hit"] + ["x"] * (gap - 1) + ["guard"]
        assert bool(held(files_of, [after], cond)) is kept
        assert bool(held(files_of, [after[::-1]], cond)) is kept


def test_scope(files_of):
    from linesieve.operators import taint
    text = "\n".join(["class A:", "  def test_x(self):", "    for i in y:", "      eval(i)", "", "def run():", "  try:",
                      "    eval(z)", "eval(w)"])
    rows = {r.line_no: r for r in taint.sink_scopes(files_of({"/s.py": text})).collect()}
    assert (rows[4].function_name, rows[4].class_name, rows[4].in_loop, rows[4].in_try, rows[4].in_test) == (
        "test_x", "A", True, False, True)
    assert (rows[8].function_name, rows[8].in_try, rows[8].in_test) == ("run", True, False)
    assert rows[9].function_name == "run"
