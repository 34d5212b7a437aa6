import re

import corpus_pipeline
from linesieve.llm import packing, quality, secret_scan
from linesieve.llm.queries import tokenizer_file
from test_simhash import brute_components, brute_fingerprint
from test_substring import brute

SF = "/root/testdata/sf0.001"


def test_stages_are_brute_force(spark):
    """All stages but the last, by plain Python over the same documents; then the pieces of the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = {r.doc_id: r.text for r in docs.collect()}
    plain = {i: t for i, t in plain.items() if quality.passes(quality.measure(t))}
    prints = [(i, brute_fingerprint(t)) for i, t in plain.items()]
    plain = {i: plain[i] for i in set(brute_components(prints, 2))}
    cut = {d: (kept, removed) for d, kept, _, removed in brute(list(plain.items()), 50)}
    now, columns = docs, docs.columns
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, SF)
        assert now.columns == columns
    for r in now.collect():
        assert " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == cut[r.doc_id][0]
        assert r.text == plain[r.doc_id] or cut[r.doc_id][1] and r.n_chars == len(r.text)
    now = corpus_pipeline.STAGES[3][1](spark, now, SF)
    hidden = {r.doc_id: r.text for r in now.collect()}
    assert hidden.keys() == plain.keys() and not any(secret_scan.ACCESS.search(t) or secret_scan.HEX.search(t) for t in hidden.values())
    ids = packing.token_ids(list(hidden.values()), tokenizer_file("byte_bpe_50k.json"))
    sizes = {i: len(own) + 1 for i, own in zip(hidden, ids)}
    packed = corpus_pipeline.run(spark, SF).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == sizes


def test_sql_is_declared():
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns_of_any_name(spark):
    """Names that the stages use themselves, values and types of which stay; repeats, nulls and empty tables."""
    names = ["_row", "chosen", "_cut", "root", "fp", "cuts", "row", "uid", "key", "_key", "kept", "_judged", "judged", "hash", "grp", "component_id",
             "cut", "_chosen", "text_", "minis", "sequence_id"]
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(1, words(0, 90), 9), (2, words(0, 90), 9), (3, words(200, 300) + " " + words(10, 80), 9), (3, words(400, 500), 9), (4, None, None),
            (None, words(600, 700), 1), (5, "", 0), (6, words(700, 760) + " password = 'q8Zk2LmP0xYv7Rt3'", 5)]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` struct<a: int>" for n in names)
    df = spark.createDataFrame([(*r, *[(i,)] * len(names)) for i, r in enumerate(rows)], schema)
    now = df
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), schema)
        assert all(len({getattr(r, n).a for n in names}) == 1 for r in now.collect())
    assert sorted((r.doc_id or 0, r.chosen.a) for r in now.collect()) == [(0, 5), (1, 0), (3, 2), (3, 3), (6, 7)]
    kept = {r.chosen.a: r for r in now.collect()}
    assert kept[2].text.strip() == words(200, 300) and kept[2].n_chars == len(kept[2].text) and "q8Zk" not in kept[7].text
    packed = corpus_pipeline.STAGES[4][1](spark, now, SF)
    assert {r.doc_id for r in packed.collect()} == {1, 3, 6, None}
    for empty in (df.limit(0), df.filter("text IS NULL")):
        for _, stage in corpus_pipeline.STAGES:
            empty = stage(spark, empty, SF)
        assert empty.collect() == []
