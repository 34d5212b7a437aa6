import random
import time

import pytest

import models
from linesieve.operators import patterns


def rules(files_of, text, name="/a.c"):
    facts = patterns.pattern_facts(files_of({name: text}))
    return {(r.rule_id, r.line_no) for r in patterns.all_findings(facts).collect()}


def test_use_after_free_cases(files_of):
    def flagged(*after):
        return ("C-UAF-001", 2) in rules(files_of, "\n".join(["void f() {", "  free(p);", *after]))
    assert flagged("  use(p);")
    assert not flagged("  p = NULL;", "  use(p);")
    assert not flagged("}", "use(p);")
    assert not flagged("  // p", "  /* p */")
    assert not flagged()


def test_use_after_free_against_the_line_model(files_of):
    rnd = random.Random(4)
    pieces = ["  free(p);", "  use(p);", "  p = NULL;", "}", "  return 1;", "  // p", "", "  x++;", "      p->a;", "int g;"]
    texts = {f"/f{i}.c": [rnd.choice(pieces) for _ in range(rnd.randint(1, 12))] for i in range(200)}
    facts = patterns.pattern_facts(files_of({k: "\n".join(v) + "\n" for k, v in texts.items()}))
    rows = patterns.use_after_free(patterns.raw_matches(facts).filter("rule_id = 'C-UAF-001'")).collect()
    want = {(k, n + 1) for k, t in texts.items() for n, line in enumerate(t)
            if line == "  free(p);" and models.used_after_free(t, n, "p")}
    assert {(r.path, r.line_no) for r in rows} == want


@pytest.mark.parametrize("seed", range(4))
def test_sweep_against_the_line_model(seed):
    """Pointers inside other names, nested scopes and comments, call by call."""
    rnd = random.Random(seed)
    names = ["p", "pp", "xp", "q", "long_name"]
    for _ in range(300):
        lines = []
        for _ in range(rnd.randint(1, 25)):
            p = rnd.choice(names)
            lines.append(" " * rnd.choice([0, 2, 4]) + rnd.choice(
                [f"free({p});", f"use({p});", f"{p} = NULL;", "}", "return 1;", f"// {p}", "", "z++;", f"/* {p} = 0", f"int {p};"]))
        calls, ends = [], []
        for n, line in enumerate(lines, 1):
            body = line.strip()
            if body.startswith("free("):
                calls.append({"at": len(calls), "line_no": n, "pointer": body[5:-2], "depth": len(line) - len(body)})
            if body == "}" or body.startswith(("return", "int ")):
                ends.append({"line_no": n, "depth": len(line) - len(body)})
        first = calls[0]["line_no"] if calls else 1
        got = set(patterns.sweep(calls, ends, first, lines[first - 1:]))
        assert got == {c["at"] for c in calls if models.used_after_free(lines, c["line_no"] - 1, c["pointer"])}, lines


def test_sweep_is_linear_in_the_calls(files_of):
    """20,000 free calls that stay open to the end of the file, where every second pointer is used."""
    n = 20_000
    text = "\n".join([f"  free(p{i:05d});" for i in range(n)] + [f"  use(p{i:05d});" for i in range(0, n, 2)])
    lines = text.split("\n")
    calls = [{"at": i, "line_no": i + 1, "pointer": f"p{i:05d}", "depth": 2} for i in range(n)]
    start = time.perf_counter()
    assert sorted(patterns.sweep(calls, [], 1, lines)) == list(range(0, n, 2))
    assert time.perf_counter() - start < 5
    facts = patterns.pattern_facts(files_of({"/big.c": text}))
    hits = patterns.use_after_free(patterns.raw_matches(facts)).filter("rule_id = 'C-UAF-001'")
    assert hits.count() == n // 2


def test_cross_engine_difference_needs_no_join(spark, files_of):
    """In-row difference beside the anti join over both tables; one read, no join."""
    from linesieve.operators import composite, post
    rnd = random.Random(6)
    pieces = ["eval(request.args)", "os.system('x' + y)", "password = 'abcdefgh'", "pass", "pickle.loads(request.data)", "hashlib.md5(password)",
              "requests.get(request.args, verify=False)", "cursor.execute('a' + request.args)"]
    texts = {f"/f{i}.py": "\n".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for i in range(60)}
    texts |= {f"/c{i}.c": "free(p);\nx;\nfree(p);\nstrcpy(a, argv[1]);\nuse(p);" for i in range(3)}
    files = files_of(texts)
    facts = patterns.pattern_facts(files, more={"held": composite.held_rules()})
    left = patterns.uncovered_findings(facts)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan  # the rule table
    assert plan.count("MapInArrow") == 1 and "hashpartitioning" not in plan
    key = lambda df: sorted((r.rule_id, r.path, r.line_no, r.matched_text) for r in df.collect())
    both = patterns.all_findings(patterns.pattern_facts(files))
    want = post.cross_engine_anti(both, composite.composite_scan(composite.composite_facts(files)))
    assert key(left) == key(want) and 0 < want.count() < both.count()


def test_allocation_checks(files_of):
    assert ("C-MEM-002", 1) in rules(files_of, "p = malloc(n);\na;\nb;\nc;\nif (p) x;")
    assert ("C-MEM-002", 1) not in rules(files_of, "p = malloc(n);\na;\nif (p) x;")


def test_double_free(files_of):
    assert ("C-MEM-001", 3) in rules(files_of, "free(p);\nx;\nfree(p);")
    assert not any(r == "C-MEM-001" for r, _ in rules(files_of, "free(p);\np = q;\nfree(p);\nfree(r);"))


def test_defensive_lines_and_languages(files_of):
    assert ("PHP-INJ-002", 1) in rules(files_of, "system($cmd);", "/a.php")
    assert not rules(files_of, "system(validate($cmd));", "/a.php")
    assert not rules(files_of, "setuid(0);", "/a.go")


def test_two_forms_of_a_rule_count_once(files_of):
    facts = patterns.pattern_facts(files_of({"/a.cs": "var f = new BinaryFormatter().Deserialize(s);"}))
    assert patterns.raw_matches(facts).filter("rule_id = 'CS-DESER-001'").count() == 1
