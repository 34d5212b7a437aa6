import math
import random

import numpy as np
import pytest

from linesieve.llm import negatives as N


def brute(rows):
    good = [(u, i, n, [math.floor(256 * x) for x in v]) for u, (i, v, n) in enumerate(rows)
            if n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for u, a, label, v in good:
        if a is None or a % 10:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), c, own == label) for t, c, own, w in good if t != u and len(v) == len(w)]
        for score, positive, _ in sorted((s for s in scored if s[2]), key=order)[:5]:
            fit = sorted((s for s in scored if not s[2] and 50 * score <= 100 * s[0] <= 95 * score), key=order)[:3]
            out += [(a, positive, n + 1, c, score, s) for n, (s, c, _) in enumerate(fit)]
    return out


def key(row):
    return [(x is None, x or 0) for x in row]


@pytest.mark.parametrize("blocks", [(4, 16, 1 << 24, 3), (4096, 4096, 300, 512), (4096, 4096, 1 << 24, 512)])
def test_is_brute_force(spark, monkeypatch, blocks):
    for name, size in zip(("ANCHOR_BLOCK", "CANDIDATE_BLOCK", "BLOCK_BYTES", "HELPING"), blocks):
        monkeypatch.setattr(N, name, size)
    rng = random.Random(21)
    common = [rng.gauss(0, 1) for _ in range(6)]
    near = lambda: [x + rng.gauss(0, 0.6) for x in common]
    rows = [(i, common if rng.random() < 0.3 else near(), rng.choice([0, 1, 1, 1, 2])) for i in range(160)]
    rows += [(200, None, 1), (210, [], 1), (211, [], 2), (212, [], 1), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (230, [math.nan] * 6, 1),
             (240, [math.inf] * 6, 1), (250, near(), None), (None, common, 1), (None, near(), 2), (10, near(), 1), rows[20], (300, [1.0, 2.0], 1),
             (301, [1.0, 2.0], 1), (302, [1.0, 1.0], 2), (310, [0.0] * 6, 7), (311, [0.0] * 6, 7)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, label int, uid int, rank string").repartition(4)
    got = [tuple(r) for r in N.hard_negatives(df, "vec_id % 10 = 0").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key) and len(got) > 100


def test_outliers_and_empty_tables(spark):
    rng = random.Random(22)
    rows = [(i, [rng.gauss(0, 1) + 1 for _ in range(8)], i % 3) for i in range(40)]
    rows += [(41, [-1e30] + [0.0] * 7, 9), (43, [-1e305] * 8, 9), (44, [1e9] + [0.0] * 7, 4), (46, [1e14] + [0.0] * 7, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in N.hard_negatives(df, "vec_id % 10 = 0").collect())
    assert got == sorted(brute(rows)) and got
    assert N.hard_negatives(df.limit(0), "vec_id % 10 = 0").collect() == []
    far = spark.createDataFrame([(0, [1e12], 1), (1, [1e12], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        N.hard_negatives(far, "vec_id = 0").collect()


@pytest.mark.parametrize("top, dims", [(3, 1), (500, 64), (1 << 20, 16), (1 << 24, 40), (1 << 40, 5)])
def test_packed_products_are_exact(top, dims):
    rng = np.random.default_rng(top)
    a, c = rng.integers(-top, top, (7, dims)), rng.integers(-top // 2, top, (23, dims))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in c] for p in a]
    assert N.scores(a, c).tolist() == want


def test_large_parts_leave_the_others_narrow():
    rng = np.random.default_rng(5)
    a, c = rng.integers(-300, 300, (6, 64)).astype(object), rng.integers(-300, 300, (9, 64)).astype(object)
    a[2, 3] = c[4, 3] = 10 ** 30
    assert N.scores(a, c).tolist() == [[sum(x * y for x, y in zip(p, q)) for q in c.tolist()] for p in a.tolist()]


def test_anchors_of_many_partitions_stand_in_full_blocks(spark, monkeypatch):
    made = []
    kept = N.blocks
    monkeypatch.setattr(N, "blocks", lambda rows, size: made.append(kept(rows, size)) or made[-1])
    rows = [(i, [float(i % 7), 1.0], i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(12)
    got = sorted(tuple(r) for r in N.hard_negatives(df, "vec_id % 10 = 0").collect())
    assert got == sorted(brute(rows)) and got
    assert made[1].count() == 1


def test_nothing_is_broadcast(spark):
    rng = random.Random(23)
    rows = [(i, [rng.gauss(0, 1) + 1 for _ in range(4)], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        got = sorted(tuple(r) for r in N.hard_negatives(df, "vec_id % 10 = 0").collect())
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got == sorted(brute([tuple(r) for r in df.collect()])) and got


def test_parts_of_two_bytes_and_wider_ones_meet(spark):
    rows = [(i, [a, b], i // 10 % 2) for i, (a, b) in enumerate(
        (x / 256, y / 256) for x in (-32768, -32767, 32766, 32767, 32767.5, 32768) for y in (-40000, -1, 0, 255.5, 32767, 32768))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert N.usable_rows(df, "vec_id", "label", "embedding", 256).groupBy("narrow").count().count() == 2
    got = sorted(tuple(r) for r in N.hard_negatives(df, "vec_id % 10 = 0").collect())
    assert got == sorted(brute(rows)) and got
