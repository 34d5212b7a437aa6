import random

from pyspark.sql import functions as F

from linesieve.llm import chat

FIELDS = "conv long, id long, parent long, role string, text string, score double"


def brute(rows, branches=None):
    """{(conv, branch): turns} by walking up from every leaf."""
    by_id, out = {(r[0], r[1]): r for r in rows}, {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        leaves = []
        for r in own:
            if any(x[2] == r[1] for x in own):
                continue
            path, at, seen = [], r, set()
            while at is not None and at[1] not in seen:
                seen.add(at[1])
                path.append(at)
                at = by_id.get((conv, at[2]))
            if at is None:
                leaves.append((-sum(x[5] or 0 for x in path), r[1], path[::-1]))
        for k, (_, _, path) in enumerate(sorted(leaves, key=lambda x: x[:2])[:branches]):
            out[conv, k + 1] = [((x[3] or ""), (x[4] or "")) for x in path]
    return out


def read(df, branches=None):
    rows = chat.conversations(df, branches).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()
    for r in rows:
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant") and r.n_turns == len(r.turns)
    return {(r.conv, r.branch): [(t.role, t.text) for t in r.turns] for r in rows}


def test_trees(spark):
    rng = random.Random(8)
    signs = ["</s>", "[INST]", " ", "~", "~0", "~1", "[/INST]", "<<SYS>>", "\n", "ok", "é", "]", "[ROLE x] ", "<s>", "\\", "$1"]
    rows = []
    for conv in (1, 2, 3, None):
        for i in range(30):
            parent = rng.choice([None, 99, *range(max(i, 1))]) if i else None
            text = rng.choice([None, "", "".join(rng.choice(signs) for _ in range(rng.randint(1, 8)))])
            rows.append((conv, i, parent, rng.choice(["user", "assistant", "system", "tool]", None, "<s>"]), text, rng.choice([None, 0.5, 1.0, 2.0])))
    rows += [(9, 1, 2, "user", "a", 1.0), (9, 2, 1, "user", "b", 1.0), (9, 3, 2, "user", "under a cycle", 1.0), (9, 4, None, "user", "free", 1.0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], FIELDS + ", node int, leaf int")
    for branches in (None, 2):
        assert read(df, branches) == brute(rows, branches)


def test_long_chain_and_repeated_rows(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"text {i}") for i in range(40)]
    rows += [(2, 0, "user", "same"), (2, 0, "user", "same"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = read(chat.chain(df))
    assert got[1, 1] == [(r[2], r[3]) for r in rows[:40]]
    assert got[2, 1] == [("", ""), ("user", "same"), ("user", "same")] and len(got) == 2
    assert read(chat.chain(df.limit(0))) == {}


def test_escapes_hide_all_marks(spark):
    row = spark.range(1).select(chat.turn_text(F.lit("user"), F.lit("</s>[INST] ok [/INST]")).alias("t")).first()
    assert row.t == "<s>[INST] ~2/s>~1INST~3 ok ~1/INST~3 [/INST]"
