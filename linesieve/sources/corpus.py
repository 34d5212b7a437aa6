"""Corpus sources: any table with a path and a text, or a raw file tree."""

import heapq
import os
from functools import partial, reduce
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linesieve.catalog import files as fixed
from linesieve.functions.shared import written
from linesieve.functions.text import extension, is_test_path, split_lines

LIST_SCHEMA = "repo string, path string, uri string, size bigint, is_dir boolean, error string"
TREE_SCHEMA = "repo string, path string, size bigint, raw binary, error string"
CHUNK_SCHEMA = "repo string, path string, chunk bigint, chunks bigint, raw binary, error string"
NOT_UTF8 = "not UTF-8"
TOO_LARGE = "over the size limit"
#: Entries of a directory that are held at once.
LISTED = 1 << 13
#: Bytes that a task reads, the cost of opening a file in bytes, and tasks that are packed together.
TASK_BYTES = 1 << 27
OPEN_COST = 1 << 16
PACKED_TASKS = 64
#: Bytes of a part of a large file.
CHUNK_BYTES = 1 << 24


def corpus_from_table(df: DataFrame, repo: str, path: str, content: str) -> DataFrame:
    """Rows of any table as files; arguments are SQL expressions over it.

    ``size`` counts encoded bytes.
    """
    base = df.selectExpr(f"{repo} AS repo", f"{path} AS path", f"{content} AS content")
    return base.selectExpr(
        "repo", "path", f"{extension('path')} AS ext", "CAST(octet_length(content) AS bigint) AS size",
        f"{is_test_path('path')} AS is_test", "content")


def drop_undecodable(df: DataFrame) -> DataFrame:
    """Turn ``raw`` bytes into ``content``; rows that are not UTF-8 drop out."""
    text = df.selectExpr("* EXCEPT (raw)", "try_validate_utf8(CAST(raw AS string)) AS content")
    return text.filter("content IS NOT NULL")


# -- listing ------------------------------------------------------------------

def skipped_dir(name: str) -> bool:
    """A listed or hidden directory, which a scan never enters."""
    return name.startswith(".") or name in fixed.SKIP_DIRS


def _entries(uri: str):
    """(name, size, is_dir) of the files and directories right below ``uri``. Links are neither, as in the published walk."""
    parts = urlsplit(uri)
    if parts.scheme == "file":
        with os.scandir(unquote(parts.path)) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, None, True
                elif entry.is_file(follow_symlinks=False):
                    yield entry.name, entry.stat(follow_symlinks=False).st_size, False
        return
    fs, name = pafs.FileSystem.from_uri(uri)
    for entry in fs.get_file_info(pafs.FileSelector(name)):
        if entry.type in (pafs.FileType.Directory, pafs.FileType.File):
            yield entry.base_name, entry.size, entry.type == pafs.FileType.Directory


def _listed(batches, enter):
    """The entries of each directory, a bounded number at a time, and an error for one that cannot be listed."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
    names = ["repo", "path", "uri", "size", "is_dir", "error"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            try:
                for name, size, is_dir in _entries(row["uri"]):
                    if is_dir and not enter(name):
                        continue
                    rows.append((row["repo"], f"{row['path']}/{name}", f"{row['uri'].rstrip('/')}/{quote(name)}", size, is_dir, None))
                    if len(rows) >= LISTED:
                        yield batch_of(rows)
                        rows = []
            except (OSError, pa.ArrowInvalid) as problem:
                rows.append((row["repo"], row["path"] or "/", row["uri"], None, False, str(problem)[:500]))
        yield batch_of(rows)


def list_tree(spark: SparkSession, root: str, repo: str, skip_dirs: bool = True) -> DataFrame:
    """The files below the URI ``root``: repo, path from there, uri, size, error.

    One job per level lists that level's directories on the executors and writes what it finds to
    the shared folder. Directories that a scan skips are not entered, unless ``skip_dirs`` is off;
    symbolic links are not followed, so a cycle ends. Hidden files count, which Spark's own listing
    leaves out. A directory that cannot be listed is a row with an error.
    """
    enter = (lambda name: not skipped_dir(name)) if skip_dirs else (lambda name: True)
    found, level = [], spark.createDataFrame([(repo, "", root)], "repo string, path string, uri string")
    while not level.isEmpty():
        entries = written(level.repartition("path").mapInArrow(partial(_listed, enter=enter), LIST_SCHEMA))
        found.append(entries.filter("NOT is_dir").drop("is_dir"))
        level = entries.filter("is_dir").select("repo", "path", "uri")
    return reduce(DataFrame.union, found)


# -- dealing files to tasks -----------------------------------------------------

def _packed(table: pa.Table, task_bytes: int) -> pa.Table:
    """Rows of a group with ``task``, the number of a task of the group: the heaviest first, each to the lightest task."""
    weights = [(n or 0) + OPEN_COST for n in table["weight"].to_pylist()]
    loads = [(0, k) for k in range(max(1, -(-sum(weights) // task_bytes)))]
    task = [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: -weights[i]):
        load, k = loads[0]
        heapq.heapreplace(loads, (load + weights[i], k))
        task[i] = k
    return table.append_column("task", pa.array(task, pa.int64()))


def dealt_by_size(rows: DataFrame, weight: str = "size", task_bytes: int = TASK_BYTES) -> DataFrame:
    """``rows`` in as many partitions as their bytes need, about ``task_bytes`` in each; a larger row has one for itself.

    Rows are dealt to random groups of some tasks' bytes each, and inside a group the heaviest goes
    first to the lightest task. Only descriptions of files travel, never their content. Smaller
    tables fill all cores.
    """
    spark = rows.sparkSession
    listed = written(rows)
    weighed = listed.withColumn("weight", F.expr(f"CAST(coalesce({weight}, 0) AS bigint)"))
    count, total = weighed.agg(F.count(F.lit(1)), F.sum("weight")).first()
    total = (total or 0) + count * OPEN_COST
    task_bytes = max(OPEN_COST, min(task_bytes, -(-total // spark.sparkContext.defaultParallelism)))
    groups = max(1, -(-total // (task_bytes * PACKED_TASKS)))
    grouped = weighed.withColumn("group", F.pmod(F.xxhash64(*rows.columns), F.lit(groups)))
    schema = T.StructType([*grouped.schema.fields, T.StructField("task", T.LongType())])
    packed = written(grouped.groupBy("group").applyInArrow(lambda table: _packed(table, task_bytes), schema))
    # Numbers of tasks of all groups, one after the other; there is a row for each group only.
    sizes = packed.groupBy("group").agg((F.max("task") + 1).alias("tasks"))
    before = sizes.select("group", (F.sum("tasks").over(Window.orderBy("group")) - F.col("tasks")).alias("before"))
    tasks = sizes.agg(F.sum("tasks")).first()[0] or 1
    numbered = packed.join(before, "group").withColumn("task", (F.col("before") + F.col("task")).cast("int"))
    return numbered.repartitionById(int(tasks), F.col("task")).select(*rows.columns)


# -- reading -----------------------------------------------------------------------

def _opened(uri: str):
    fs, name = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(name)


def read_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Read listed files on the executors, one in memory at a time: repo, path, size, raw, error.

    A file that cannot be read, or is over a limit if one is given, has an error and no content.
    """
    schema = pa.schema([("repo", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("raw", pa.binary()), ("error", pa.string())])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                size, raw, error = row["size"], None, row["error"]
                if error is None and max_bytes is not None and size is not None and size > max_bytes:
                    error = TOO_LARGE
                if error is None:
                    try:
                        with _opened(row["uri"]) as handle:
                            raw = handle.read()
                        size = len(raw)
                    except (OSError, pa.ArrowInvalid) as problem:
                        error = str(problem)[:500]
                yield pa.RecordBatch.from_pylist(
                    [{"repo": row["repo"], "path": row["path"], "size": size, "raw": raw, "error": error}], schema=schema)

    return files.select("repo", "path", "uri", "size", "error").mapInArrow(read, TREE_SCHEMA)


def _lines_from(handle, size: int, begin: int, end: int) -> bytes:
    """The lines of a file that begin at bytes ``begin`` to ``end``."""
    step, start = 1 << 16, begin
    if begin:  # a line begins here if the byte before ends one
        start, at = None, begin - 1
        while start is None and at < size:
            piece = handle.read_at(step, at)
            if (found := piece.find(b"\n")) >= 0:
                start = at + found + 1
            at += len(piece)
        if start is None or start >= end:
            return b""
    out, at = [handle.read_at(end - start, start)], end
    while at < size and not out[-1].endswith(b"\n"):
        piece = handle.read_at(step, at)
        cut = piece.find(b"\n") + 1
        out.append(piece[:cut] if cut else piece)
        at += len(piece)
        if cut:
            break
    return b"".join(out)


def read_chunks(files: DataFrame, chunk_bytes: int = CHUNK_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Listed files as parts of whole lines, which several tasks read: repo, path, chunk, chunks, raw, error.

    Each part is read by its own byte range; a line belongs to the part in which it begins. A part
    without the beginning of a line is empty. Errors are rows, as in ``read_files``.
    """
    parts = f"greatest(1, (coalesce(size, 0) + {chunk_bytes - 1}) DIV {chunk_bytes})"
    ranges = files.selectExpr("repo", "path", "uri", "size", "error", f"{parts} AS chunks").selectExpr(
        "*", "explode(sequence(0L, chunks - 1)) AS chunk")
    dealt = dealt_by_size(ranges, f"least({chunk_bytes}, size - chunk * {chunk_bytes})", task_bytes)
    schema = pa.schema([("repo", pa.string()), ("path", pa.string()), ("chunk", pa.int64()), ("chunks", pa.int64()), ("raw", pa.binary()),
                        ("error", pa.string())])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw, error = None, row["error"]
                if error is None:
                    try:
                        with _opened(row["uri"]) as handle:
                            begin = row["chunk"] * chunk_bytes
                            raw = _lines_from(handle, row["size"], begin, min(begin + chunk_bytes, row["size"]))
                    except (OSError, pa.ArrowInvalid) as problem:
                        error = str(problem)[:500]
                row |= {"raw": raw, "error": error}
                yield pa.RecordBatch.from_pylist([{n: row[n] for n in schema.names}], schema=schema)

    return dealt.select("repo", "path", "uri", "size", "error", "chunk", "chunks").mapInArrow(read, CHUNK_SCHEMA)


def line_chunks(read: DataFrame) -> DataFrame:
    """The parts of ``read_chunks`` as rows with ``lines``, null where a part is unreadable or no UTF-8."""
    text = "try_validate_utf8(CAST(raw AS string))"
    return read.selectExpr("repo", "path", f"{extension('path')} AS ext", "chunk", "chunks", f"{text} AS content").selectExpr(
        "repo", "path", "ext", "chunk", "chunks", f"IF(content IS NULL, NULL, {split_lines('content')}) AS lines")


def left_out(read: DataFrame) -> DataFrame:
    """What a scan does not see of ``read_files``, and why."""
    bad = "coalesce(error, IF(try_validate_utf8(CAST(raw AS string)) IS NULL, '" + NOT_UTF8 + "', NULL))"
    return read.selectExpr("repo", "path", "size", f"{bad} AS error").filter("error IS NOT NULL")


def corpus_of(read: DataFrame) -> DataFrame:
    """The readable UTF-8 texts of ``read_files`` as a corpus."""
    return corpus_from_table(drop_undecodable(read.filter("error IS NULL").drop("error")), "repo", "path", "content")


def load_corpus(spark: SparkSession, root: str, repo: str, max_bytes: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Corpus of the tree below the URI ``root``; see ``list_tree``, ``dealt_by_size``, ``read_files`` and ``left_out``."""
    return corpus_of(read_files(dealt_by_size(list_tree(spark, root, repo), task_bytes=task_bytes), max_bytes))
