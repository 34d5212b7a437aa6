import random
import re

import numpy as np
import pyarrow as pa
import pytest

from linesieve.llm import substring


def brute(rows, window):
    """(doc_id, kept words, n, removed) by a dictionary of all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), own in zip(rows, words):
        for i in range(len(own) - window + 1 if d is not None else 0):
            key = tuple(own[i:i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), own in zip(rows, words):
        gone = {j for i in range(len(own) - window + 1 if d is not None else 0) if first[tuple(own[i:i + window])] < d for j in range(i, i + window)}
        out.append((d, " ".join(w for j, w in enumerate(own) if j not in gone), len(own), len(gone)))
    return sorted(out, key=str)


def corpus(rng, n, window):
    words = ["a", "b", "c", "é", "dd", "漢"] + [f"w{i}" for i in range(40)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [text(rng.randint(window - 2, 3 * window)) for _ in range(6)] + [["a"] * 2 * window, ["a", "b"] * window]
    rows = []
    for i in range(n):
        own = text(rng.randint(0, 2 * window))
        for _ in range(rng.randint(0, 3)):
            own += rng.choice(passages)[rng.choice([0, 0, 3]):] + text(rng.randint(0, window))
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(own)))
    return rows + [(n + 5, rows[3][1]), (2, rows[4][1]), (3, rows[3][1]), (None, rows[3][1]), (n + 6, None), (n + 7, ""), (n + 8, " x ")]


@pytest.mark.parametrize(("window", "size"), [(50, 8), (12, 4), (8, 8)])
def test_is_brute_force(spark, window, size):
    rows = corpus(random.Random(window), 60, window)
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], "doc_id long, text string, _cut int, row string").repartition(3)
    out = substring.deduplicate(df, window, size).collect()
    got = [(r.doc_id, " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r._cut.n_words, r._cut.n_removed) for r in out]
    assert sorted(got, key=str) == brute(rows, window)
    by_text = {r.doc_id: r.text for r in out if r._cut.n_removed == 0}
    assert all(by_text[d] == t for d, t in rows if d in by_text and [x for x, _ in rows].count(d) == 1)
    assert substring.deduplicate(df.limit(0), window, size).collect() == []


def test_documents_keep_their_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, len(text), "x"), (2, "new " + text + " end", 7, "y"), (3, None, 9, "z")],
                               "doc_id long, text string, n_chars long, _row string")
    out = substring.deduplicate_documents(df)
    assert out.schema == df.schema
    assert sorted(map(tuple, out.collect())) == [(1, text, len(text), "x"), (2, "new end", 7, "y"), (3, None, 9, "z")]


def test_rolled_hashes_depend_on_the_words_alone():
    rng = random.Random(1)
    words = np.array([rng.getrandbits(64) for _ in range(40)], np.uint64)
    for n in (1, 2, 3, 8, 13):
        hashes = substring.rolled(words, n, substring._BASE)
        assert len(hashes) == 41 - n
        assert all(substring.rolled(words[i:i + n], n, substring._BASE)[0] == hashes[i] for i in range(41 - n))
    assert len(substring.rolled(words[:3], 4, substring._BASE)) == 0


def test_super_kmers_hold_every_window_once():
    rng = random.Random(2)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(n)] for n in (300, 0, 19, 20, 40)]
    _, text, first, count = substring.runs(texts, 20, 5)
    for i, own in enumerate(texts):
        windows = [w for t, s, n in zip(text, first, count) if t == i for w in range(s, s + n)]
        assert windows == list(range(max(0, len(own) - 19)))
        alone = substring.runs([own], 20, 5)
        assert first[text == i].tolist() == alone[2].tolist()


def test_a_hot_minimiser_is_settled_by_windows(spark, monkeypatch):
    """With one string as the limit of a bucket every contested minimiser takes the way of the hot ones."""
    rows = corpus(random.Random(3), 60, 12)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substring.earlier_windows, "__defaults__", (12, 1))
    out = substring.deduplicate(df, 12, 4).collect()
    got = [(r.doc_id, " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r._cut.n_words, r._cut.n_removed) for r in out]
    assert sorted(got, key=str) == brute(rows, 12)


def bucket_rows(strings, minis, firsts, lasts, **more):
    """What a bucket returns for packed strings numbered from 0: (kind, string, place, stop)."""
    batch = pa.RecordBatch.from_arrays(
        [pa.array(minis, pa.int64()), pa.array(strings), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64()),
         pa.array(range(len(strings)), pa.int64())], names=["mini", "packed", "first", "last", "string"])
    out = [r for b in substring._sort_buckets([batch], **more) for r in b.to_pylist()]
    return sorted((r["kind"], r["string"], r["place"], r["stop"]) for r in out)


def test_repeated_windows_in_a_row_are_one_row():
    words = [f"w{i}" for i in range(200)]
    strings = [" ".join(words), " ".join(words[20:120]), " ".join([*words[150:170], "x", *words[170:200]])]
    got = bucket_rows(strings, [7, 7, 7], [1, 5, 9], [1, 6, 9], window=12, limit=100)
    assert got == [(substring.EARLIER, 1, 0, 89), (substring.EARLIER, 2, 0, 9), (substring.EARLIER, 2, 21, 40), (substring.WHOLE, 1, 0, 0)]


def test_a_bucket_makes_the_windows_of_few_strings_at_once(monkeypatch):
    sizes, windows = [], substring._windows
    monkeypatch.setattr(substring, "_windows", lambda strings, window: sizes.append(len(strings)) or windows(strings, window))
    text = " ".join(f"w{i}" for i in range(15))
    n = 2 * substring.BUCKET
    minis, firsts = np.arange(n) // 2, np.arange(n) % 2
    got = bucket_rows([f"{text} {i}" for i in range(n)], minis, firsts, firsts, window=12, limit=substring.BUCKET)
    assert got == [(substring.EARLIER, i, 0, 4) for i in range(1, n, 2)]
    assert sum(sizes) == n and max(sizes) <= substring.STRINGS + 2
    sizes.clear()
    assert len(bucket_rows([f"{text} {i}" for i in range(3000)], [1] * 3000, range(3000), range(3000), window=12, limit=2000)) == 5 * 3000
    assert max(sizes) <= substring.STRINGS
