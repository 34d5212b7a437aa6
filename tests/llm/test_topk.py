import math
import random

import pytest

from linesieve.llm import topk


def brute(rows, k):
    good = [(u, i, [math.floor(1024 * x) for x in v]) for u, (i, v) in enumerate(rows)
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for u, q, a in good:
        if q % 10 == 0:
            own = sorted((-sum(x * y for x, y in zip(a, b)), c) for t, c, b in good if t != u and len(a) == len(b))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize("bins", [4096, 8])
def test_is_brute_force(spark, monkeypatch, bins):
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    rng = random.Random(12)
    common = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, common if rng.random() < 0.4 else [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(160, None), (170, []), (171, []), (171, []), (20, rows[20][1]), (30, [0.5] * 6), (180, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (190, [math.nan] * 6), (200, [math.inf] * 6), (None, common),
             (210, [1.0, 2.0]), (211, [3.0, 4.0]), (220, [5.0]), (230, [0.0] * 6), (230, [1.0] * 6), (15, rows[15][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score int, rank int").repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(df, "vec_id % 10 = 0").collect())
    assert got == brute(rows, 10)


def test_large_parts_and_few_rows(spark):
    rows = [(0, [1e6, -1e6]), (1, [1e6, 1e6]), (2, [-1e6, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, "vec_id % 10 = 0").collect()) == brute(rows, 10)
    assert topk.top_k(df.limit(0), "vec_id % 10 = 0").collect() == []
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>"), "vec_id = 0")
    alone = spark.createDataFrame([(0, [1e9])], "vec_id long, embedding array<double>")
    assert topk.top_k(alone, "vec_id = 0").collect() == []


def test_outliers_keep_the_others_results(spark):
    rng = random.Random(14)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(30)] + [(31, [190_000.0] + [0.0] * 63), (32, [0.0] * 63 + [1e12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, "vec_id % 10 = 0").collect()) == brute(rows, 10)
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [-1e17])], "vec_id long, embedding array<double>"), "vec_id = 0")


def test_only_a_result_beyond_a_long_is_an_error(spark):
    """Very large parts beside ordinary rows, and scores between 2^61 and 2^63, which fit."""
    rng = random.Random(15)
    rows = [(i, [abs(rng.gauss(0, 1)) * 0.8 for _ in range(2)]) for i in range(40)]
    rows += [(41, [-1e30, 0.0]), (43, [0.0, 1.5e12]), (50, [0.0, 4.0]), (61, [-1e28, -1e27])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, "vec_id % 10 = 0").collect())
    assert got == brute(rows, 10)
    assert any(2 ** 61 < s < 2 ** 63 for _, _, _, s in got)


def test_rows_that_share_an_id_are_candidates_of_each_other(spark):
    df = spark.createDataFrame([(100, [1.0]), (100, [2.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:3] for r in topk.top_k(df, "vec_id % 100 = 0").collect())
    assert got == [(100, 1, 1), (100, 1, 100), (100, 2, 1), (100, 2, 100)] or got == [(100, 1, 100), (100, 1, 100), (100, 2, 1), (100, 2, 1)]
