import random
from itertools import combinations

import pytest
import xxhash

from linesieve.llm import simhash


def brute_fingerprint(text, n=3):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """{index: smallest id} over rows (id, fingerprint) by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprints():
    rng = random.Random(9)
    texts = ["", " \n", "One", "one TWO", "É é ÀB c", "a b c", "a\x0bb\x1cc d"]
    texts += [" ".join(rng.choice(["The", "of", "x", "Äpfel", "漢"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_some_mask_misses_any_bits_of_the_radius(radius):
    masks = simhash.covering_masks(radius, 24)
    for bits in combinations(range(24), radius):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_no_link_is_missed(spark):
    rng = random.Random(10)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(300):  # chains, stars and near misses around them
        x = rng.choice(prints)
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    rows = [(simhash.signed(p),) for p in dict.fromkeys(prints)]
    df = spark.createDataFrame(rows, "fp long")
    links = [(a % 2**64, b % 2**64) for a, b in simhash.links(df, 2).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    found = {n % 2**64: r for n, r in simhash.components(spark.createDataFrame([(simhash.signed(a), simhash.signed(b)) for a, b in links], "a long, b long")).collect()}
    own = [p % 2**64 for (p,) in rows]
    names = brute_components([(simhash.signed(p), p) for p in own], 2)
    assert [found.get(p, simhash.signed(p)) for p in own] == names


def test_near_duplicates(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(8)]
    texts = [rng.choice(base).replace(f"w{rng.randrange(300)} ", "changed ", 1) for _ in range(60)] + base + ["", None, "  ", "Short", "short"]
    rows = [(i if i != 7 else None, t, "c", 1) for i, t in enumerate(texts)] + [(3, texts[3], "c", 1), (4, "w1 w2 other", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp int")
    prints = [(r[0], brute_fingerprint(r[1] or "")) for r in rows]
    want = [(d, p, c) for (d, p), c in zip(prints, brute_components(prints, 2))]
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash.one_of_each(df)
    named = [(d, p) for d, p in prints if d is not None]
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted(set(brute_components(named, 2)))
    assert kept.columns == df.columns and kept.filter("doc_id IS NULL").count() == 1
    assert simhash.near_duplicates(df.limit(0)).collect() == simhash.one_of_each(df.limit(0)).collect() == []


def test_one_row_of_each_component(spark):
    rng = random.Random(13)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(200)) for _ in range(5)]
    rows = [(1, texts[0], "x"), (2, texts[1], "x"), (2, texts[2], "x"), (3, texts[2], "x"), (5, texts[0], "x"),
            (None, texts[3], "x"), (None, texts[3], "x"), (None, texts[3], "y"), (1, texts[4], "x"), (1, texts[4], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(df).collect()]
    assert sorted(kept, key=str) == sorted([(1, texts[0]), (2, texts[1]), (2, texts[2]), (None, texts[3]), (1, texts[4])], key=str)
