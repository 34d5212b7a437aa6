import random
import time

import models
from linesieve.operators import flow, taint


def taints(files_of, text, name="/a.py"):
    return taint.taint_findings(taint.taint_facts(files_of({name: text}))).collect()


def flows(files_of, text, name="/a.py"):
    return flow.flow_paths(flow.flow_facts(files_of({name: text}))).collect()


def gap(n, sink="eval(q)"):
    return "\n".join(["q = request.args"] + ["pass"] * (n - 1) + [sink])


def test_taint_distance(files_of):
    assert taints(files_of, gap(19))[0].confidence == "HIGH"
    assert taints(files_of, gap(20))[0].confidence == "MEDIUM"


def test_flow_distance(files_of):
    assert flows(files_of, gap(14))[0].confidence == "HIGH"
    assert flows(files_of, gap(15))[0].confidence == "MEDIUM"
    for n, want in ((19, "HIGH"), (20, "MEDIUM")):
        text = "\n".join(["q = request.args", "z = q"] + ["pass"] * (n - 2) + ["eval(z)"])
        assert [r.confidence for r in flows(files_of, text) if r.hops == 1] == [want]


def test_sanitizer_range(files_of):
    def clean(text):
        return taints(files_of, text)[0].is_sanitized
    assert not clean("q = request.args # shlex.quote\nos.system(q)")
    assert clean("q = request.args\nx = shlex.quote(q)\nos.system(q)")
    assert clean("q = request.args\nos.system(shlex.quote(q))")
    assert not clean("q = request.args\nos.system(q)\nshlex.quote(q)")


def test_false_sources(files_of):
    for text in ("q = input()['a'].keys()\neval(q)", "@pytest.mark.parametrize('x', [\n  1,\nq = request.args\neval(q)",
                 "q = request.args = 'x'\neval(q)"):
        assert taints(files_of, text) == []
    assert taints(files_of, "@pytest.fixture\nx = 1\nq = request.args\neval(q)")


def test_safe_calls(files_of):
    kinds = [r.sink.sink_type for r in taints(files_of, "q = request.args\nsubprocess.run([q], shell=False, exec(q))")]
    assert "command_execution" not in kinds


def test_test_scope_and_path(files_of):
    assert taints(files_of, "def test_a():\n  q = request.args\n  eval(q)")[0].severity == "INFO"
    assert taints(files_of, gap(2), "/tests/a.py")[0].confidence == "LOW"


def test_propagation_chain_has_the_root_source(files_of):
    rows = flows(files_of, "src = request.args\nb = src\nc = b\neval(c)")
    assert [(r.source_var, r.source_line, r.variable) for r in rows] == [("src", 1, "c")]
    assert [s.step for s in rows[0].steps] == ["source", "propagation", "sink"]
    assert flows(files_of, "eval(zz)\nzz = request.args") == []
    assert flows(files_of, "bb = aa\naa = request.args\neval(bb)") == []


def test_environment_sources_are_low(files_of):
    assert {(r.severity, r.confidence) for r in flows(files_of, "q = sys.argv\neval(q)")} == {("LOW", "LOW")}


def test_spread_against_the_fold_model(files_of):
    rnd = random.Random(5)
    names = ["aa", "bb", "cc", "dd", "aab"]
    texts = {}
    for i in range(100):
        texts[f"/f{i}.py"] = [f"{rnd.choice(names)} = {rnd.choice(['request.args', *names, 'aa + cc', 'zz'])}"
                              for _ in range(rnd.randint(2, 15))]
    files = files_of({k: "\n".join(v) for k, v in texts.items()})
    got = {}
    for r in flow.propagate(flow.flow_facts(files)).collect():
        got.setdefault(r.path, set()).add((r.line_no, r.variable, r.root_line, r.root))
    for path, lines in texts.items():
        pairs = [(n + 1, *line.split(" = ", 1)) for n, line in enumerate(lines)]
        sources = [(v, n) for n, v, side in pairs if side == "request.args"]
        assert got.get(path, set()) == models.derived(lines, sources, pairs), path


def test_long_chains_of_derived_variables(files_of):
    """50,000 variables in one file, each taken from the one before."""
    lines = ["v0 = request.args", *[f"v{i} = f(v{i - 1})" for i in range(1, 50_000)], "eval(v49999)"]
    facts = flow.flow_facts(files_of({"/a.py": "\n".join(lines)}))
    rows = flow.propagate(facts).groupBy("root").count().collect()
    assert [(r.root, r["count"]) for r in rows] == [("v0", 49_999)]


def test_steps_hold_the_text_of_their_lines(files_of):
    row = flows(files_of, "src = request.args\nb = src\nc = b\neval(c)")[0]
    assert [s.text for s in row.steps] == ["src = request.args", "c = b", "eval(c)"]


def test_flow_ids_number_a_file(files_of):
    ids = [r.flow_id for r in flows(files_of, "q = request.args\neval(q)\nopen(q)")]
    assert sorted(ids) == [f"FLOW-{n:04d}" for n in range(1, len(ids) + 1)]


def test_sinks_and_sources_meet_as_intervals(files_of):
    """400 sources of one variable above 400 sinks are 400 rows, until single pairs are asked for."""
    text = "\n".join(["q = request.args"] * 400 + ["eval(q)"] * 400)
    facts = taint.taint_facts(files_of({"/a.py": text}))
    rows = taint.tainted_intervals(facts).filter("sink.sink_type = 'code_execution'").selectExpr("sink.line_no AS at", "sources").collect()
    assert len(rows) == 400 and all([s.line_no for s in r.sources] == list(range(1, 401)) for r in rows)
    assert taint.tainted_pairs(facts).filter("sink.sink_type = 'code_execution'").count() == 160_000


def test_reached_sinks_against_all_pairs():
    rnd = random.Random(7)
    names = ["a", "ab", "b", "abc", "zz", "q", "long"]
    for _ in range(200):
        sources = [{"variable": rnd.choice(names), "line_no": n} for n in sorted(rnd.choices(range(1, 30), k=rnd.randint(1, 15)))]
        sinks = [{"text": " ".join(rnd.choices(names + ["xabcx", "(", "lon"], k=3)), "line_no": rnd.randint(1, 30)} for _ in range(10)]
        order, reach = taint.reached_sinks(sources, sinks)
        got = [(order[i], r["sink"]) for r in reach for i in range(r["start"], r["start"] + r["n"])]
        assert sorted(got) == [(i, k) for i, s in enumerate(sources) for k, t in enumerate(sinks)
                               if s["line_no"] < t["line_no"] and s["variable"] in t["text"]]


def test_linked_against_all_pairs():
    """Reaching variables, steps and cleaning lines of random files beside plain filters."""
    rnd = random.Random(9)
    names = ["a", "ab", "b", "cd", "e"]
    for _ in range(200):
        sources = [{"variable": rnd.choice(names), "line_no": n, "source_type": rnd.choice("xy")} for n in sorted(rnd.choices(range(1, 20), k=3))]
        assigns = [{"line_no": n, "variable": rnd.choice(names), "side": rnd.choice(names + ["a + cd", "?"]), "text": f"t{n}"}
                   for n in sorted(rnd.choices(range(1, 40), k=12))]
        sinks = [{"text": " ".join(rnd.choices(names + ["xabx", "("], k=2)), "line_no": rnd.randint(1, 45)} for _ in range(6)]
        cleaners = [{"text": rnd.choice(names), "line_no": n} for n in sorted(rnd.sample(range(1, 45), 5))]
        derived, by_root, reach = flow.linked(sources, assigns, sinks, cleaners)
        assert derived == flow.spread(sources, assigns)
        want = []
        for k, t in enumerate(sinks):
            for hops, table in ((0, sources), (1, derived)):
                for i, v in enumerate(table):
                    if v["line_no"] < t["line_no"] and v["variable"] in t["text"]:
                        passed = sorted({(d["line_no"], d["variable"], d["text"]) for d in derived
                                         if (d["root_line"], d["root"]) == (v["line_no"], v["variable"]) and d["line_no"] < t["line_no"]})
                        clean = any(v["line_no"] < z["line_no"] <= t["line_no"] and v["variable"] in z["text"] for z in cleaners)
                        want.append((k, hops, i, passed if not hops else [], clean))
        got = [(r["sink"], r["hops"], r["at"], [(d["line_no"], d["variable"], d["text"]) for d in (derived[i] for i in by_root[r["start"]:r["start"] + r["n"]])],
                r["clean"]) for r in reach]
        assert sorted(got) == sorted(want)


def test_many_derived_variables_take_linear_time(files_of):
    """5,000 variables taken from one source, and a sink for each: one look-up a sink, steps as intervals."""
    n = 5_000
    sources = [{"variable": "src", "line_no": 1, "source_type": "x"}]
    assigns = [{"line_no": i + 2, "variable": f"v{i:05d}", "side": "src", "text": ""} for i in range(n)]
    sinks = [{"text": f"eval(v{i:05d})", "line_no": n + 2 + i} for i in range(n)]
    start = time.perf_counter()
    derived, by_root, reach = flow.linked(sources, assigns, sinks, [])
    assert time.perf_counter() - start < 5
    assert len(derived) == len(by_root) == len(reach) == n
    text = "\n".join(["src = request.args", *[f"v{i:05d} = src" for i in range(n)], *[f"eval(v{i:05d})" for i in range(n)], "eval(src)"])
    pairs = flow.flow_pairs(flow.flow_facts(files_of({"/a.py": text}))).filter("sink.sink_type = 'code_execution'")
    assert [(r.hops, r.n, r["count"]) for r in pairs.selectExpr("hops", "size(middle) AS n").groupBy("hops", "n").count().orderBy("hops").collect()] == [
        (0, n, 1), (1, 1, n)]
