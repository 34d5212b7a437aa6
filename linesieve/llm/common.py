"""What the operators share: tables in the shared folder, Arrow kernels over texts, word boundaries."""

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linesieve.functions.shared import shared_folder, written as saved

__all__ = ["saved", "shared_folder"]

#: Rows of texts that a task works on at once.
SLICE = 1 << 11
#: Bytes that separate words: space and tab to carriage return.
WORD_BREAKS = b" \t\n\x0b\x0c\r"
_BREAK_TABLE = np.zeros(256, dtype=bool)
_BREAK_TABLE[list(WORD_BREAKS)] = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers started in another folder find this package, too.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches, rows: int = SLICE):
    """Arrow batches in parts of at most ``rows`` rows, so that fewer texts are held twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not: ``name`` with underscores before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def map_texts(df: DataFrame, kernel, fields: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of every row, then the ``fields`` (DDL) that ``kernel(texts)`` returns.

    ``kernel`` gets the column ``text`` as a list of str, null as empty, and returns one Arrow
    array or list for each field. A kept column named like a field gives way to the field. Rows
    are neither dropped nor moved; batches hold at most Arrow's record limit of whole rows.
    """
    added = T.StructType.fromDDL(fields)
    keep = [c for c in (keep or []) if c not in added.names]
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    types = arrow_schema(schema)

    def batches(source):
        for batch in sliced(source):
            texts = ["" if t is None else t for t in batch.column(len(keep)).to_pylist()]
            made = kernel(texts)
            arrays = [batch.column(i).cast(types.field(i).type) for i in range(len(keep))]
            arrays += [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, f.type)
                       for a, f in zip(made, list(types)[len(keep):])]
            yield pa.RecordBatch.from_arrays(arrays, schema=types)

    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    return source.mapInArrow(batches, schema)


def finite_lists(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, starts, ends, data): the lists that are not null and hold neither null nor non-finite numbers, in one array of doubles."""
    there = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
    own = values.drop_null()
    data = own.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null parts as NaN
    ends = np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    seen = np.append(0, np.cumsum(~np.isfinite(data)))
    good = np.flatnonzero(seen[ends] == seen[starts])
    return there[good], starts[good], ends[good], data


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of UTF-8 ``data``: the runs without word breaks."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_BREAK_TABLE[np.frombuffer(data, np.uint8)], out=inside[1:-1].view(bool))
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def words_of(data: bytes) -> list[bytes]:
    """The words of UTF-8 ``data``; ``bytes.split`` breaks at exactly the same six bytes."""
    return data.split()


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``flat[s:s + n]`` for every start and length, one after the other."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(total)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of a public generator, splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
