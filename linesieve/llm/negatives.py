"""Hard negatives by exact inner products of packed candidates.

A block of candidates is biased to non-negative parts, and several candidates share one wide
integer, each in a field that no sum of products can leave (Kronecker substitution). One
multiplication per part of an anchor then advances the scores of all of them; shifts and masks
unpack the sums, and the biases are taken off again. Where the fields fit into 53 bits the wide
integers are doubles, whose sums stay exact, and the products are one matrix product; else they are
Python integers of any width.

Two passes over the blocks: the best rows of the anchor's label, then, for the score range that each
of them sets, the best rows of other labels. Scores are never stored. Blocks meet in sort-merge joins:
Spark takes a copied block for as small as its file, and would send all copies by the driver.
"""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesieve.llm.common import finite_lists, saved

POSITIVES = 5
NEGATIVES = 3
SCALE = 256
#: Percentages of the positive's score between which a negative's score lies.
LEAST, MOST = 50, 95
#: Rows of a block at most, and its bytes. Every block of anchors is one copy of the candidates, so the anchors stand in full blocks.
ANCHOR_BLOCK = 4096
CANDIDATE_BLOCK = 4096
BLOCK_BYTES = 1 << 24
#: Anchors whose scores with a block of candidates are held at once.
HELPING = 512
#: Bits of an exact double, and candidates that share a Python integer where a double is too small.
DOUBLE_BITS = 53
WIDE_FIELDS = 8
LONG = (-(1 << 63), (1 << 63) - 1)

#: Scaled parts up to this travel as two bytes each.
NARROW = (1 << 15) - 1

ROW_FIELDS = "vec_id long, label long, uid long, dims int, narrow boolean, vector binary"


def usable_rows(rows: DataFrame, vec_id: str, label: str, vector: str, scale: int) -> DataFrame:
    """vec_id, label, a unique number, length and parts, of the rows whose label and parts are all there and finite.

    The parts of a ``narrow`` row are scaled, two bytes each; those of another are the doubles.
    """

    def convert(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            labelled = batch.filter(batch.column(1).is_valid())
            good, starts, ends, data = finite_lists(labelled.column(2))
            with np.errstate(over="ignore"):
                whole = np.floor(data * float(scale))
            fits = np.abs(whole) <= NARROW
            short, wider = np.where(fits, whole, 0).astype(np.int16), np.append(0, np.cumsum(~fits))
            narrow = wider[ends] == wider[starts]
            made = [(short if n else data)[a:b].tobytes() for n, a, b in zip(narrow.tolist(), starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [labelled.column(0).take(pa.array(good)), labelled.column(1).take(pa.array(good)), pa.array(uid + np.arange(len(good))),
                 pa.array((ends - starts).astype(np.int32)), pa.array(narrow), pa.array(made, pa.binary())],
                names=["vec_id", "label", "uid", "dims", "narrow", "vector"])
            uid += len(good)

    return rows.select(F.col(f"`{vec_id}`").cast("long"), F.col(f"`{label}`").cast("long"), F.col(f"`{vector}`")).mapInArrow(convert, ROW_FIELDS)


BLOCK_FIELDS = "dims int, narrow boolean, rows array<struct<vec_id: long, label: long, uid: long>>, vectors binary"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of one length and width put together, at most ``size`` in a block and about BLOCK_BYTES bytes of parts as doubles."""

    def gather(batches):
        held: dict[tuple, list] = {}

        def block(kind):
            own = held.pop(kind)
            heads = [{"vec_id": v, "label": n, "uid": u} for v, n, u, _ in own]
            return pa.RecordBatch.from_pydict(
                {"dims": [kind[0]], "narrow": [kind[1]], "rows": [heads], "vectors": [b"".join(r[3] for r in own)]}, schema=schema)

        for batch in batches:
            for dims, narrow, *row in zip(*[c.to_pylist() for c in batch.columns]):
                own = held.setdefault((dims, narrow), [])
                own.append(row)
                if len(own) >= size or len(own) * dims * 8 >= BLOCK_BYTES:
                    yield block((dims, narrow))
        for kind in list(held):
            yield block(kind)

    head = pa.struct([("vec_id", pa.int64()), ("label", pa.int64()), ("uid", pa.int64())])
    schema = pa.schema([("dims", pa.int32()), ("narrow", pa.bool_()), ("rows", pa.list_(head)), ("vectors", pa.binary())])
    return rows.select("dims", "narrow", "vec_id", "label", "uid", "vector").mapInArrow(gather, BLOCK_FIELDS)


def scaled(parts: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64, or Python integers where a part is too large for exact doubles."""
    with np.errstate(over="ignore"):
        made = np.floor(parts * float(scale))
    if not made.size or np.abs(made).max() < 2.0 ** DOUBLE_BITS:
        return made.astype(np.int64)
    whole = [int(x) * scale if abs(x) >= 2.0 ** DOUBLE_BITS else int(np.floor(x * scale)) for x in parts.reshape(-1).tolist()]
    return np.array(whole, object).reshape(parts.shape)


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products (anchors, candidates) of two integer matrices: int64, or Python integers where that is too small.

    Rows with very large parts are multiplied apart, so that the others keep their narrow fields.
    """
    dims = anchors.shape[1]
    if not dims or not len(anchors) or not len(candidates):
        return np.zeros((len(anchors), len(candidates)), np.int64)
    narrow = 1 << (DOUBLE_BITS - dims.bit_length()) // 2 - 1
    small = [np.array(np.abs(m).max(axis=1) < narrow, bool) for m in (anchors, candidates)]
    if small[0].all() and small[1].all():
        return _products(anchors.astype(np.int64), candidates.astype(np.int64))
    out = np.empty((len(anchors), len(candidates)), object)
    for i in (small[0], ~small[0]):
        for j in (small[1], ~small[1]):
            if i.any() and j.any():
                a, c = (anchors[i].astype(np.int64), candidates[j].astype(np.int64)) if i is small[0] and j is small[1] else (anchors[i], candidates[j])
                out[np.ix_(i, j)] = _products(a, c)
    return out.astype(np.int64) if all(LONG[0] <= x <= LONG[1] for x in out.reshape(-1).tolist()) else out


def _products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    dims = anchors.shape[1]
    lift, raised = int(anchors.min()), int(candidates.min())
    # Products of the lifted parts are not negative, and their sum never leaves a field of ``bits``.
    bits = (dims * (int(anchors.max()) - lift) * (int(candidates.max()) - raised)).bit_length() or 1
    largest = dims * max(-lift, int(anchors.max())) * max(-raised, int(candidates.max()))
    doubles = bits <= DOUBLE_BITS and anchors.dtype == candidates.dtype == np.int64 and abs(largest) < 1 << 61
    if not doubles:
        anchors, candidates = anchors.astype(object), candidates.astype(object)
    fields, kind = (DOUBLE_BITS // bits, np.float64) if doubles else (WIDE_FIELDS, object)
    wide = np.zeros((-(-len(candidates) // fields), dims), kind)
    for field in range(fields):
        own = (candidates[field::fields] - raised).astype(kind)
        wide[:len(own)] += own * (1 << bits * field)
    sums = (anchors - lift).astype(kind) @ wide.T
    if doubles:
        sums = sums.astype(np.int64)
    products = np.empty((len(anchors), len(candidates)), sums.dtype)
    for field in range(fields):
        n = len(candidates[field::fields])
        products[:, field::fields] = (sums[:, :n] >> bits * field) & ((1 << bits) - 1)
    return products + raised * anchors.sum(axis=1)[:, None] + lift * candidates.sum(axis=1)[None, :] - dims * lift * raised


def _head(rows, name: str) -> np.ndarray:
    """A number of each row of a block, null as the largest long, which comes last among ties."""
    return np.array([LONG[1] if r[name] is None else r[name] for r in rows], np.int64)


def _rows(batch: pa.RecordBatch):
    """The rows of a batch, one at a time, since a row holds two blocks."""
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]


def _matrix(row: dict, side: str, scale: int) -> np.ndarray:
    narrow = row[f"{side}_narrow"]
    parts = np.frombuffer(row[f"{side}_vectors"], np.int16 if narrow else np.float64).reshape(len(row[f"{side}_rows"]), row["dims"])
    return parts.astype(np.int64) if narrow else scaled(parts, scale)


def _pair(row: dict, scale: int, helping: int):
    """The anchors of a block, a helping at a time: which they are, their scores with the candidates, where the labels and where the
    rows are the same, and the candidates' ids."""
    a, c = [_matrix(row, x, scale) for x in "ac"]
    heads = [[_head(row[f"{x}_rows"], name) for name in ("label", "uid")] for x in "ac"]
    ids = _head(row["c_rows"], "vec_id")
    for at in range(0, len(a), helping):
        part = slice(at, at + helping)
        same, own = [left[part, None] == right[None, :] for left, right in zip(*heads)]
        yield part, scores(a[part], c), same, own, ids


def _best(own: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of positions ``at`` with the highest scores, ties to the smaller id."""
    if own.dtype == object:
        return np.array(sorted(at.tolist(), key=lambda i: (-own[i], ids[i]))[:k], np.int64)
    if len(at) > k:
        at = at[own[at] >= np.partition(own[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -own[at]))][:k]


def _fitting(score) -> int:
    score = int(score)
    if not LONG[0] <= score <= LONG[1]:
        raise OverflowError("the score of a result does not fit into 64 bits")
    return score


POSITIVE_FIELDS = "uid long, anchor_id long, vec_id long, c_uid long, score long"


def _positives(batches, scale: int, k: int, helping: int):
    for batch in batches:
        for row in _rows(batch):
            out = []
            for part, found, same, own, ids in _pair(row, scale, helping):
                for i, anchor in enumerate(row["a_rows"][part]):
                    for j in _best(found[i], np.flatnonzero(same[i] & ~own[i]), ids, k).tolist():
                        out.append((anchor["uid"], anchor["vec_id"], row["c_rows"][j]["vec_id"], row["c_rows"][j]["uid"],
                                    _fitting(found[i, j])))
            yield _batch(out, ["uid", "anchor_id", "vec_id", "c_uid", "score"])


NEGATIVE_FIELDS = "uid long, nth int, negative_id long, negative_score long"


def _negatives(batches, scale: int, k: int, least: int, most: int, helping: int):
    for batch in batches:
        for row in _rows(batch):
            out = []
            for part, found, same, _, ids in _pair(row, scale, helping):
                for i, (anchor, positives) in enumerate(zip(row["a_rows"][part], row["positives"][part])):
                    other = np.flatnonzero(~same[i])
                    own = found[i][other]
                    for nth, score in enumerate(positives or ()):
                        # least * score <= 100 * own <= most * score, in whole numbers
                        within = other[(own >= -(-least * score // 100)) & (own <= most * score // 100)]
                        for j in _best(found[i], within, ids, k).tolist():
                            out.append((anchor["uid"], nth, row["c_rows"][j]["vec_id"], _fitting(found[i, j])))
            yield _batch(out, ["uid", "nth", "negative_id", "negative_score"], {"nth": pa.int32()})


def _batch(rows: list[tuple], names: list[str], kinds: dict | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, (kinds or {}).get(n, pa.int64())) for n, c in zip(names, columns)], names=names)


def _pairs(anchors: DataFrame, candidates: DataFrame, extra: list[str]) -> DataFrame:
    """Every block of candidates beside every block of anchors of its length.

    Blocks of anchors are dealt to numbers, blocks of candidates to parts; either is copied for all
    of the other's, and they are joined on both, so few blocks of anchors still fill many tasks.
    The copies are shuffled, never broadcast.
    """
    n = max(1, anchors.count())
    parts = max(1, min(candidates.count(), int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    left = candidates.select("dims", *[F.col(c).alias(f"c_{c}") for c in ("narrow", "rows", "vectors")],
                             F.pmod(F.xxhash64("rows.uid"), F.lit(parts)).alias("part"),
                             F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("number"))
    right = anchors.select("dims", F.pmod(F.xxhash64("rows.uid"), F.lit(n)).alias("number"),
                           *[F.col(c).alias(f"a_{c}") for c in ("narrow", "rows", "vectors")], *extra,
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    return left.join(right.hint("merge"), ["number", "part", "dims"]).drop("number", "part")


def hard_negatives(rows: DataFrame, is_anchor: str, label: str = "label", vec_id: str = "vec_id", vector: str = "embedding",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, least: int = LEAST,
                   most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where the SQL condition ``is_anchor`` over vec_id holds; ``label`` is an
    SQL expression. A score is the inner product of floor(scale * x), exact. An anchor's positives
    are its ``positives`` best other rows of its label, a positive's negatives the ``negatives``
    best rows of other labels with least% to most% of the positive's score; higher scores first,
    ties to the smaller vec_id, null last.

    Rows with a null label, a null vector or a null or non-finite part take no part. Rows are told
    apart as rows: repeated ones are anchors, positives and negatives of their own, also with the
    anchor's id. Empty vectors score 0 with each other; vectors of different lengths do not meet. A
    positive without negatives has no row; an empty table gives an empty result. Other columns take
    no part, whatever their names. A result whose score does not fit into a long is an error;
    larger scores elsewhere are not.
    """
    named = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.expr(label).cast("long").alias("label"),
                        F.col(f"`{vector}`").alias("vector"))
    usable = saved(usable_rows(named, "vec_id", "label", "vector", scale))
    candidates = saved(blocks(usable, CANDIDATE_BLOCK))
    asked = usable.filter(F.expr(is_anchor))
    anchors = saved(blocks(asked.repartition(max(1, -(-asked.count() // ANCHOR_BLOCK))), ANCHOR_BLOCK))
    found = _pairs(anchors, candidates, []).mapInArrow(partial(_positives, scale=scale, k=positives, helping=HELPING), POSITIVE_FIELDS)
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "c_uid")
    nth = (F.row_number().over(order) - 1).alias("nth")
    chosen = saved(found.select("uid", "anchor_id", "vec_id", "score", nth).filter(F.col("nth") < positives))
    # The ranges travel with the anchors' blocks, in the order of their rows.
    ranges = chosen.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("nth", "score")))["score"].alias("scores"))
    spread = anchors.select(F.xxhash64("rows.uid").alias("block"), F.posexplode("rows").alias("place", "row")).select("block", "place", "row.uid")
    listed = (spread.join(ranges.hint("merge"), "uid", "left").groupBy("block")
              .agg(F.sort_array(F.collect_list(F.struct("place", "scores")))["scores"].alias("positives")))
    ready = saved(anchors.withColumn("block", F.xxhash64("rows.uid")).join(listed.hint("merge"), "block").drop("block"))
    kept = _pairs(ready, candidates, ["positives"]).mapInArrow(
        partial(_negatives, scale=scale, k=negatives, least=least, most=most, helping=HELPING), NEGATIVE_FIELDS)
    place = Window.partitionBy("uid", "nth").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    ranked = kept.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= negatives)
    return ranked.join(chosen.hint("merge"), ["uid", "nth"]).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
