import random
import re
import zlib
from collections import Counter

import pytest

from linesieve.llm import variants as V


def brute_words(docs, planted=True):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if planted and i is not None and h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    out, forms = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_apart(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 2 * n else None
        out[w] = len(near)
    rows = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, out[w], counts[forms[w]] if forms[w] else None))
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_all_neighbours(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abÀÿ" if seed % 2 else "ab") for _ in range(rng.randint(5, 9))) for _ in range(150)})
    index = V.Index(words)
    got = set()
    for beginning in (True, False):
        for a, b in zip(*index.near(words, beginning)):
            v, w = words[a], words[b]
            assert w.startswith(v[:len(v) // 2]) if beginning else w.endswith(v[len(v) // 2:])
            got.add((v, w))
    assert got == {(v, w) for v in words for w in words if one_apart(v, w)}


def test_searched_words_beyond_the_index():
    index = V.Index(["abcde", "abcdef", "zzzzz"])
    lanes, found = index.near(["abxde", "qqqqq", "abcdefg"], True)
    assert list(zip(lanes.tolist(), found.tolist())) == [(0, 0), (2, 1)]


@pytest.mark.parametrize("cell", [4096, 8])
def test_is_brute_force(spark, cell):
    rng = random.Random(31)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    def word():
        w = stems[min(int(rng.expovariate(0.12)), 59)]
        if rng.random() < 0.4:
            at = rng.randrange(len(w) + 1)
            w = w[:at] + rng.choice(["", "a", "Ö", "z"]) + w[at + rng.randint(0, 1):]
        return w.upper() if rng.random() < 0.1 else w
    docs = [(i, " ".join(word() + rng.choice(["", ",", "1", "×"]) for _ in range(rng.randint(0, 120)))) for i in range(150)]
    docs += [(200, None), (201, ""), (None, docs[0][1]), (3, docs[3][1]), (3, docs[3][1]), (202, "x" * 50_000 + " 1")]
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(5)
    got = sorted((tuple(r) for r in V.variants(df, cell=cell).collect()), key=lambda r: r[0])
    want = brute(brute_words(docs))
    assert got == want
    assert any(r[2] not in (r[0], r[1]) for r in want) and any(r[4] == 0 for r in want)


def test_empty_and_single(spark):
    schema = "doc_id long, text string"
    assert V.variants(spark.createDataFrame([], schema)).collect() == []
    one = spark.createDataFrame([(1, "lonely lonely lonely")], schema)
    assert [tuple(r) for r in V.variants(one, change=None).collect()] == [("lonely", None, "lonely", 3, 0, None)]
