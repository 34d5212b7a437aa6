"""Exact top k by distributed histogram selection.

Queries and candidates meet in blocks. Every round scores all pairs of a block and counts, for
each query, the scores by histogram bins; the sum over the blocks shows which bin holds the k-th
best score, and the next round divides that bin. Scores are integers, so the bins end at one
value each: the k-th score itself. A last round returns what lies above it, and of its ties as
many as are missing, smallest ids first. Scores are never stored.
"""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesieve.llm.common import finite_lists, saved

K = 10
#: Bins that a query's range is divided into in each round.
BINS = 4096
#: Vectors of a block of queries and of candidates.
QUERY_BLOCK = 256
CANDIDATE_BLOCK = 4096

VECTOR_FIELDS = "vec_id long, uid long, dims int, vector binary"
_EXACT = 2.0 ** 53
#: Sums of products up to LARGEST are taken in 64 bits; a query that can meet larger ones is settled in whole numbers of any size.
LARGEST = 2.0 ** 61
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1


def integer_vectors(rows: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """vec_id, a unique number, length and floor(scale * x) as doubles, of the vectors without null or non-finite parts.

    A part beyond the largest double counts as that.
    """

    def convert(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            named = batch.filter(batch.column(0).is_valid())
            good, starts, ends, data = finite_lists(named.column(1))
            with np.errstate(over="ignore"):
                data = np.nan_to_num(np.floor(data * scale))
            made = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [named.column(0).take(pa.array(good)), pa.array(uid + np.arange(len(good))), pa.array((ends - starts).astype(np.int32)),
                 pa.array(made, pa.binary())], names=["vec_id", "uid", "dims", "vector"])
            uid += len(good)

    return rows.select(F.col(f"`{vec_id}`").cast("long"), F.col(f"`{vector}`")).mapInArrow(convert, VECTOR_FIELDS)


def _blocks(rows: DataFrame, size: int, extra: list[str]) -> DataFrame:
    """Rows of one length put together into blocks of at most ``size``: lists of numbers and one binary of all vectors."""
    fields = "dims int, ids binary, uids binary, vectors binary" + "".join(f", {c} binary" for c in extra)

    def gather(batches):
        held: dict[int, list] = {}

        def block(dims):
            own = held.pop(dims)
            columns = [[dims], [np.array([r[0] for r in own], np.int64).tobytes()], [np.array([r[1] for r in own], np.int64).tobytes()],
                       [b"".join(r[2] for r in own)]]
            columns += [[np.array([r[3 + k] for r in own], np.int64).tobytes()] for k in range(len(extra))]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                                              names=["dims", "ids", "uids", "vectors", *extra])

        for batch in batches:
            for dims, *row in zip(*[c.to_pylist() for c in batch.columns]):
                held.setdefault(dims, []).append(row)
                if len(held[dims]) >= size:
                    yield block(dims)
        for dims in list(held):
            yield block(dims)

    return rows.select("dims", "vec_id", "uid", "vector", *extra).mapInArrow(gather, fields)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _matrix(row: dict, side: str) -> np.ndarray:
    return np.frombuffer(row[side + "vectors"], np.float64).reshape(len(_longs(row[side + "uids"])), row["dims"])


def _itself(row: dict) -> np.ndarray:
    """Which candidates of a pair of blocks are the query's own row."""
    return _longs(row["q_uids"])[:, None] == _longs(row["c_uids"])[None, :]


def _scores(row: dict) -> np.ndarray:
    """Inner products of a pair of blocks, (queries, candidates), below LARGEST; a query's own row gets the least integer."""
    a, b = _matrix(row, "q_"), _matrix(row, "c_")
    if row["dims"] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < _EXACT:
        scores = (a @ b.T).astype(np.int64)
    else:  # parts that make a larger product meet zeros only, but for wide queries, which do not count here
        scores = np.clip(a, -LARGEST, LARGEST).astype(np.int64) @ np.clip(b, -LARGEST, LARGEST).astype(np.int64).T
    scores[_itself(row)] = LEAST_LONG
    return scores


def _too_large(row: dict) -> np.ndarray:
    """For each query of a pair of blocks, whether a sum of products can reach LARGEST, told from doubles."""
    with np.errstate(over="ignore"):
        sums = np.abs(_matrix(row, "q_")) @ np.abs(_matrix(row, "c_")).T
    sums[_itself(row)] = 0
    return (sums >= LARGEST).any(axis=1)


def _widest(batches, k: int):
    """The best ``k`` candidates of each query in a block, in whole numbers of any size; ``over`` if a score does not fit into a long."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            whole = [np.array([int(x) for x in m.reshape(-1).tolist()], object).reshape(m.shape) for m in (_matrix(row, "q_"), _matrix(row, "c_"))]
            scores, own, ids = whole[0] @ whole[1].T, _itself(row), _longs(row["c_ids"]).tolist()
            for i, (uid, query) in enumerate(zip(_longs(row["q_uids"]).tolist(), _longs(row["q_ids"]).tolist())):
                best = sorted((-int(scores[i, j]), ids[j]) for j in np.flatnonzero(~own[i]).tolist())[:k]
                out += [(uid, query, v, max(LEAST_LONG, min(-s, MOST_LONG)), not LEAST_LONG <= -s <= MOST_LONG) for s, v in best]
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.bool_()])],
                                         names=["uid", "query_id", "vec_id", "score", "over"])


def _extremes(batches):
    """The least and the highest score of each query in a block; a query without candidates has none in between."""
    none = np.iinfo(np.int64)
    for batch in batches:
        uids, low, high, over = [], [], [], []
        for row in batch.to_pylist():
            scores = _scores(row)
            uids.append(_longs(row["q_uids"]))
            low.append(np.where(scores == none.min, none.max, scores).min(axis=1))
            high.append(scores.max(axis=1))
            over.append(_too_large(row))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(t)) for x, t in ((uids, np.int64), (low, np.int64), (high, np.int64), (over, bool))],
            names=["uid", "low", "high", "over"])


def _pairs(candidates: DataFrame, queries: DataFrame, extra: list[str]) -> DataFrame:
    """Every block of candidates beside every block of queries of its length: the blocks of queries
    are dealt to as many numbers, a block of candidates is copied for each number and joined on it."""
    blocks = saved(_blocks(queries, QUERY_BLOCK, extra))
    n = max(1, blocks.count())
    left = candidates.select("dims", *[F.col(c).alias(f"c_{c}") for c in ("ids", "uids", "vectors")],
                             F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("number"))
    right = blocks.select("dims", F.pmod(F.xxhash64("uids"), F.lit(n)).alias("number"),
                          *[F.col(c).alias(f"q_{c}") for c in ("ids", "uids", "vectors", *extra)])
    return left.join(right, ["number", "dims"])


def _best_bins(scores: np.ndarray, low: np.ndarray, span: np.ndarray, width: np.ndarray, need: np.ndarray):
    """For each query the bins, from the top, that hold its ``need`` best scores of the block within the range.

    A bin below these cannot hold the k-th score of all blocks, so no block sends more than k bins.
    """
    for i in range(len(scores)):
        own = scores[i]
        own = own[(own >= low[i]) & (own < low[i] + span[i])]
        if len(own) > need[i]:
            own = np.partition(own, len(own) - need[i])[len(own) - need[i]:]
        bins, counts = np.unique((own - low[i]) // width[i], return_counts=True)
        yield i, bins, counts


def _histogram(batches):
    for batch in batches:
        uids, all_bins, all_counts = [], [], []
        for row in batch.to_pylist():
            scores = _scores(row)
            query = _longs(row["q_uids"])
            for i, bins, counts in _best_bins(scores, *[_longs(row[f"q_{c}"]) for c in ("low", "span", "width", "need")]):
                uids.append(np.full(len(bins), query[i]))
                all_bins.append(bins)
                all_counts.append(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in (uids, all_bins, all_counts)],
            names=["uid", "bin", "n"])


def _chosen(batches):
    for batch in batches:
        out = [[], [], [], []]
        for row in batch.to_pylist():
            scores, query, ids = _scores(row), _longs(row["q_uids"]), _longs(row["c_ids"])
            for i, (low, need) in enumerate(zip(_longs(row["q_low"]).tolist(), _longs(row["q_need"]).tolist())):
                own = scores[i]
                above = np.flatnonzero(own > low)
                ties = np.flatnonzero((own == low) & (own > np.iinfo(np.int64).min))
                ties = ties[np.argsort(ids[ties], kind="stable")[:need]]
                take = np.concatenate([above, ties])
                for column, x in zip(out, (np.full(len(take), query[i]), np.full(len(take), _longs(row["q_ids"])[i]), ids[take], own[take])):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in out],
                                         names=["uid", "query_id", "vec_id", "score"])


def top_k(rows: DataFrame, is_query: str, k: int = K, vec_id: str = "vec_id", vector: str = "embedding",
          scale: float = 1024.0) -> DataFrame:
    """Each query's ``k`` highest integer scores: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    Queries are the rows where the SQL condition ``is_query`` over the column ``vec_id`` holds; all
    rows but the query's own are its candidates. Null ids and vectors that are null or hold null or
    non-finite parts take no part; vectors of different lengths do not meet, empty ones score 0. A
    query with fewer candidates gets them all. Rows that repeat, or share an id, are candidates and
    queries of their own, for each other, too. An empty table gives an empty result; other columns
    take no part. A score of the result that does not fit into a long is an error; larger scores
    elsewhere are not.
    """
    vectors = saved(integer_vectors(rows, vec_id, vector, scale))
    candidates = saved(_blocks(vectors, CANDIDATE_BLOCK, []))
    queries = vectors.filter(F.expr(is_query))
    # The first range of a query reaches from its least to its highest score.
    found = _pairs(candidates, queries, []).mapInArrow(_extremes, "uid long, low long, high long, over boolean")
    found = saved(found.groupBy("uid").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("over").alias("over")))
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    state = saved(queries.join(found.filter("NOT over AND low <= high"), "uid").select(
        "vec_id", "uid", "dims", "vector", "low", F.expr("high - low + 1").alias("span"),
        F.expr(f"(high - low + {BINS}) DIV {BINS}").alias("width"), F.lit(k).cast("long").alias("need")))
    width = state.agg(F.max("width")).first()[0] or 1
    while True:
        pairs = _pairs(candidates, state, ["low", "span", "width", "need"])
        bins = pairs.mapInArrow(_histogram, "uid long, bin long, n long").groupBy("uid", "bin").agg(F.sum("n").alias("n"))
        state = saved(_narrowed(state, bins))
        if width == 1:
            break
        width = -(-width // BINS)
    best = _pairs(candidates, state, ["low", "need"]).mapInArrow(_chosen, "uid long, query_id long, vec_id long, score long")
    if not found.filter("over").isEmpty():
        wide = _pairs(candidates, queries.join(found.filter("over").select("uid"), "uid"), []).mapInArrow(
            partial(_widest, k=k), "uid long, query_id long, vec_id long, score long, over boolean")
        wide = saved(wide.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k))
        if not wide.filter("over").isEmpty():
            raise ValueError("a score of the result does not fit into a long")
        best = best.union(wide.select("uid", "query_id", "vec_id", "score"))
    # Rows above the k-th score and up to ``need`` ties of each block; a task passes on its best k for each query.
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _narrowed(state: DataFrame, found: DataFrame) -> DataFrame:
    """The range of each query's k-th score, one bin of its range before, and how many are missing there.

    A query with fewer candidates than it needs keeps the least bin that has any: everything is above its end.
    """
    bins = found.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))
    walked = F.aggregate(
        "bins", F.struct(F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("above"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.when(acc["above"] + acc["n"] >= F.col("need"), acc).otherwise(
            F.struct(x["bin"].alias("bin"), (acc["above"] + acc["n"]).alias("above"), x["n"].alias("n"))))
    joined = state.join(bins, "uid").withColumn("w", walked)
    return joined.select(
        "vec_id", "uid", "dims", "vector", (F.col("low") + F.col("w.bin") * F.col("width")).alias("low"),
        F.col("width").alias("span"), F.expr(f"(width + {BINS - 1}) DIV {BINS}").alias("width"), (F.col("need") - F.col("w.above")).alias("need"))
