import random
import re

import pytest

from linesieve.llm import decontaminate as D


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items, window=10):
    own, hit, named = words(text), set(), set()
    for item, body in items:
        w = words(body)
        k = min(window, len(w))
        for p in {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else ():
            for at in range(len(own) - k + 1):
                if tuple(own[at:at + k]) == p:
                    hit.update(range(at, at + k))
                    if item is not None:
                        named.add(str(item))
    return len(own), sorted(hit), sorted(named)


def spread(runs):
    assert all(a["stop"] < b["start"] for a, b in zip(runs, runs[1:]))
    return [i for r in runs for i in range(r["start"], r["stop"])]


def made(seed):
    rng = random.Random(seed)
    alphabet = ["a", "b", "the", "Of", "é", "漢", "x1"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(alphabet) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 9, 10, 11, 30]) if i > 6 else rng.randint(10, 40))) for i in range(14)]
    items += [(3, items[5][1]), (None, say(12)), (90, None), (91, ""), (92, "!! --"), (10, items[2][1])]
    docs = []
    for i in range(60):
        text = say(rng.randint(0, 60))
        if i % 2:
            text += " " + (rng.choice(items)[1] or "") + ". " + say(rng.randint(0, 20))
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, "--"), (1, docs[1][1]), (None, items[2][1]), (103, "the" * 5)]
    return items, docs


@pytest.mark.parametrize("seed, pass_bytes, helping, lane", [(1, 1 << 25, 1 << 20, 256), (2, 700, 1 << 20, 8), (3, 1 << 25, 40, 3)])
def test_is_brute_force(spark, monkeypatch, seed, pass_bytes, helping, lane):
    monkeypatch.setattr(D, "LANE", lane)
    monkeypatch.setattr(D, "HELPING", helping)
    monkeypatch.setattr(D, "TABLED", 16)
    items, docs = made(seed)
    df = spark.createDataFrame([(*d, 1, "h") for d in docs], "doc_id long, text string, uid int, hit string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    if helping == 1 << 20:
        found = D.contamination(df, bench, ["doc_id", "text", "hit"], pass_bytes=pass_bytes).collect()
        got = sorted(((r.doc_id, r.text), r.n_words, spread(r.hit), r.items) for r in found if r.doc_id is not None)
    else:  # small helpings are seen in this process only
        search = D.Search(D.pa.table({"window": [w.decode() for _, t in items for w in D.windows_of(t)],
                                      "item": [None if i is None else str(i) for i, t in items for _ in D.windows_of(t)]}))
        rows = list(search.scan([t or "" for _, t in docs]))
        got = sorted(((i, t), n, [x for a, b in runs for x in range(a, b)], own) for (i, t), (n, runs, own) in zip(docs, rows) if i is not None)
    assert got == sorted(((i, t), *brute(t, items)) for i, t in docs if i is not None)
    assert any(n for _, _, n, _ in got)


def test_empty_tables_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in D.contamination(docs, bench, ["doc_id"]).collect()] == [(1, 2, [], [])]
    assert D.contamination(docs.limit(0), docs.toDF("item_id", "text"), ["doc_id"]).collect() == []
    planted = " ".join(f"w{i}" for i in range(12))
    text = ("filler text " * 150_000) + planted + " " + "x" * 2_000_000 + " " + planted
    search = D.Search(D.pa.table({"window": [w.decode() for w in D.windows_of(planted)], "item": ["7"] * 3}))
    (n, runs, items), = search.scan([text])
    assert (n, runs, items) == (300_025, [(300_000, 300_012), (300_013, 300_025)], ["7"])


def test_words_are_cut():
    assert D.without_hits("One two-three, É four", [(1, 2), (3, 4)]) == "One -three,  four"
