"""Substring deduplication: words under a window of 50 that also starts in an earlier document.

The windows of a document are cut into super-k-mers: runs of consecutive windows that share a
minimiser, the m words of least hash in the window. A run travels as one packed string, the words
under all its windows, to the bucket of its minimiser. Equal windows have equal minimisers, so
they meet in one bucket. Only runs whose minimiser occurs in two documents travel at all.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.llm.common import fresh, map_texts, mix64, saved, sliced, word_bounds

WINDOW = 50
#: Words of a minimiser.
MINIMISER = 8
#: Words that are hashed at once; strings of one minimiser that a task sorts at most, and strings whose windows it makes
#: at once, unless one minimiser has more.
HELPING = 1 << 16
BUCKET = 1 << 13
STRINGS = 1 << 10

_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), np.uint64)


def rolled(hashes: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A hash of each ``n`` consecutive word hashes, put together from runs of 1, 2, 4, ... words."""
    if len(hashes) < n:
        return hashes[:0]
    run, have, out, done = hashes, 1, None, 0
    while True:
        if n & have:  # ``out`` covers the first ``done`` words from each place, ``run`` the next ``have``
            size = len(hashes) - done - have + 1
            out = run[:size] if out is None else mix64(out[:size] * base + run[done:done + size])
            done += have
        if done == n:
            return out
        run = mix64(run[:len(run) - have] * base + run[have:])
        have *= 2


def minimisers(hashes: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, position) of the minimiser of every window: the leftmost of least hash among its ``size``-word grams."""
    grams = rolled(hashes, size, _OTHER)
    span = window - size + 1
    n = len(grams) - span + 1
    if n <= 0:
        return grams[:0], np.zeros(0, np.int64)
    best, at, have = grams, np.arange(len(grams)), 1
    while have < span:  # sparse doubling; two overlapping ranges cover the span
        step = min(have, span - have)
        left, right = best[:len(best) - step], best[step:]
        take = right < left
        best = np.where(take, right, left)
        at = np.where(take, at[step:], at[:len(at) - step])
        have += step
    return best[:n], at[:n]


def runs(words: list[list[bytes]], window: int = WINDOW, size: int = MINIMISER):
    """Super-k-mers of several texts: (minimiser, text, first window, number of windows).

    The texts' words are hashed as one array; windows that reach into the next text do not count.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    value, at = minimisers(word_hashes([w for own in words for w in own]), window, size)
    if not len(at):
        return value, at, at, at
    text = np.repeat(np.arange(len(words)), lengths)
    own = np.flatnonzero(text[:len(at)] == text[window - 1:])
    at, value, text = at[own], value[own], text[own]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]))) if len(own) else own
    starts = np.cumsum(lengths) - lengths
    return value[first], text[first], own[first] - starts[text[first]], np.diff(np.append(first, len(own)))


def _helpings(texts: list[str]):
    """Yields (index of the first, their words) for runs of texts with HELPING words or one text more."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.encode().split())
        size += len(held[-1])
        if size >= HELPING:
            yield first, held
            first, held, size = i + 1, [], 0
    yield first, held


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def document_minimisers(docs: DataFrame, window: int = WINDOW, size: int = MINIMISER) -> DataFrame:
    """doc_id, ``row`` (a hash of id and text) and ``minis``, the distinct minimisers of each text with a window."""

    def kernel(texts):
        found = [np.zeros(0, np.uint64)] * len(texts)
        for first, words in _helpings(texts):
            value, text, _, _ = runs(words, window, size)
            for i, own in enumerate(np.split(value, np.searchsorted(text, np.arange(1, len(words))))):
                if len(own):
                    found[first + i] = np.unique(own)
        bounds = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        return [pa.ListArray.from_arrays(bounds, _signed(np.concatenate([*found, np.zeros(0, np.uint64)])))]

    made = map_texts(docs.select("doc_id", "text", row_key().alias("row")), kernel, "minis array<long>", "text", ["doc_id", "row"])
    return made.filter(F.size("minis") > 0)


def row_key() -> F.Column:
    return F.xxhash64("doc_id", "text")


def shared_minimisers(found: DataFrame) -> DataFrame:
    """row, ``minis``: of every document the minimisers that a document of another id has, too."""
    each = found.select("doc_id", "row", F.explode("minis").alias("mini"))
    common = each.groupBy("mini").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    return each.join(common.select("mini"), "mini").groupBy("row").agg(F.collect_set("mini").alias("minis"))


SUPER_FIELDS = "mini long, doc_id long, row long, start int, n int, packed string"


def string_key() -> F.Column:
    return F.xxhash64("mini", "packed")


def super_kmers(docs: DataFrame, chosen: DataFrame, window: int = WINDOW, size: int = MINIMISER) -> DataFrame:
    """The runs of windows whose minimiser is among the row's ``chosen`` ones, each with its words packed into one string.

    ``string`` is the string's key, so that who needs no words need not read them.
    """
    schema = docs.sparkSession.createDataFrame([], SUPER_FIELDS).schema
    source = docs.select("doc_id", row_key().alias("row"), "text").join(chosen, "row").select("doc_id", "row", "text", "minis")

    def packed(batches):
        for batch in sliced(batches):
            ids, rows, texts, chosen_minis = [c.to_pylist() for c in batch.columns]
            for first, words in _helpings(texts):
                value, text, start, count = runs(words, window, size)
                value = value.view(np.int64)
                wanted = [np.array(m, np.int64) for m in chosen_minis[first:first + len(words)]]
                cuts = np.searchsorted(text, np.arange(len(words) + 1))
                own = np.concatenate([np.isin(value[a:b], m) for a, b, m in zip(cuts, cuts[1:], wanted)] or [np.zeros(0, bool)])
                value, text, start, count = value[own], text[own], start[own], count[own]
                strings = [b" ".join(words[t][s:s + n + window - 1]) for t, s, n in zip(text.tolist(), start.tolist(), count.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value), pa.array([ids[first + t] for t in text.tolist()], pa.int64()),
                     pa.array([rows[first + t] for t in text.tolist()], pa.int64()), pa.array(start.astype(np.int32)),
                     pa.array(count.astype(np.int32)), pa.array(strings, pa.binary()).cast(pa.string())], names=schema.names)

    return source.mapInArrow(packed, schema).withColumn("string", string_key())


BUCKET_FIELDS = "kind int, string long, place int, stop int, first long, w1 long, w2 long"
#: Kinds of rows that a bucket returns.
EARLIER, WHOLE, OPEN = range(3)


def _windows(strings: list[bytes], window: int):
    """All windows of the packed strings: (string, place in it, two independent hashes of the words)."""
    words = [s.split() for s in strings]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    hashes = word_hashes([w for own in words for w in own])
    one, two = rolled(hashes, window, _BASE), rolled(mix64(hashes), window, _OTHER)
    text = np.repeat(np.arange(len(words)), lengths)
    own = np.flatnonzero(text[:len(one)] == text[window - 1:]) if len(one) else np.zeros(0, np.int64)
    starts = np.cumsum(lengths) - lengths
    return text[own], own - starts[text[own]], one[own], two[own]


def _rows(kind: int, string, place, stop, first, w1, w2) -> pa.RecordBatch:
    n = len(string)
    place, stop, first, w1, w2 = (np.broadcast_to(x, n) for x in (place, stop, first, w1, w2))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(string.astype(np.int64)), pa.array(place.astype(np.int32)),
         pa.array(stop.astype(np.int32)), pa.array(first.astype(np.int64)), _signed(w1.astype(np.uint64)), _signed(w2.astype(np.uint64))],
        names=["kind", "string", "place", "stop", "first", "w1", "w2"])


def _parts(minis: np.ndarray):
    """Slices of the sorted ``minis`` with about STRINGS of them, cut where a minimiser ends."""
    heads = np.append(np.flatnonzero(np.append(True, minis[1:] != minis[:-1])), len(minis))
    at = 0
    while at < len(minis):
        upto = int(heads[np.searchsorted(heads, min(at + STRINGS, len(minis)))])
        yield slice(at, upto)
        at = upto


def _sort_buckets(batches, window: int, limit: int):
    """Sorts the windows of each minimiser's strings, which come one minimiser after the other.

    Returns the runs of windows of a string that other strings have from earlier documents (EARLIER),
    and the strings of several documents (WHOLE). Strings of a minimiser that has more than ``limit``
    of them go on as windows without a verdict (OPEN), so no group is held whole.
    """

    def settle(minis, strings, firsts, ids):
        for part in _parts(minis):
            yield from settle_part(minis[part], strings[part], firsts[part], ids[part])

    def settle_part(minis, strings, firsts, ids):
        _, of, counts = np.unique(minis, return_inverse=True, return_counts=True)
        several = np.flatnonzero(counts[of] > 1)  # a lone string needs no look at its windows
        text, place, w1, w2 = _windows([strings[i] for i in several.tolist()], window)
        if not len(text):
            return
        string = several[text]
        order = np.lexsort((firsts[string], w2, w1))
        head = np.append(True, (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1]))
        least = firsts[string][order][head][np.cumsum(head) - 1]
        late = least < firsts[string][order]
        picked = np.sort(order[late])  # string by string, in the order of their windows
        string, place = string[picked], place[picked]
        head = np.flatnonzero(np.append(True, (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1))) if len(picked) else picked
        begin = place[head]
        yield _rows(EARLIER, ids[string[head]], begin, begin + np.diff(np.append(head, len(picked))), 0, 0, 0)

    def hand_on(strings, firsts, ids):
        for at in range(0, len(strings), STRINGS):
            text, place, w1, w2 = _windows(strings[at:at + STRINGS], window)
            text += at
            yield _rows(OPEN, ids[text], place, place + 1, firsts[text], w1, w2)

    held, open_mini = None, None
    for batch in batches:
        minis, firsts, lasts, ids = (batch.column(i).to_numpy() for i in (0, 2, 3, 4))
        strings = batch.column(1).cast(pa.binary()).to_pylist()
        shared = firsts < lasts
        yield _rows(WHOLE, ids[shared], 0, 0, firsts[shared], 0, 0)
        rest = np.searchsorted(minis, open_mini, side="right") if open_mini is not None and len(minis) and minis[0] == open_mini else 0
        if rest:
            yield from hand_on(strings[:rest], firsts[:rest], ids[:rest])
        new = (minis[rest:], strings[rest:], firsts[rest:], ids[rest:])
        held = new if held is None else (np.append(held[0], new[0]), held[1] + new[1], np.append(held[2], new[2]), np.append(held[3], new[3]))
        if len(held[0]) >= limit:
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:  # all minimisers but the last one are complete
                yield from settle(held[0][:last], held[1][:last], held[2][:last], held[3][:last])
            held = tuple(x[last:] for x in held)
            if len(held[0]) > limit:
                open_mini = held[0][0]
                yield from hand_on(*held[1:])
                held = None
    if held is not None and len(held[0]):
        yield from settle(*held)


def earlier_windows(supers: DataFrame, window: int = WINDOW, limit: int = BUCKET) -> DataFrame:
    """(row, start, stop): windows of a document, by number, that also start in a document with a smaller id.

    Equal packed strings become one, with their smallest and largest doc_id, before they travel to
    the bucket of their minimiser. There the strings are sorted window by window. A minimiser with
    very many different strings around it is not settled in one task: its windows are dealt by
    their hashes and their first document is found by a partial minimum. A window that starts before
    the first document of its string is gone from all documents of the string.
    """
    strings = supers.groupBy("mini", "packed").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    bucket = strings.select("mini", "packed", "first", "last", string_key().alias("string"))
    found = saved(bucket.repartition("mini").sortWithinPartitions("mini").mapInArrow(
        partial(_sort_buckets, window=window, limit=limit), BUCKET_FIELDS))
    open_rows = found.filter(F.col("kind") == OPEN)
    least = open_rows.groupBy("w1", "w2").agg(F.min("first").alias("least"), F.max("first").alias("most")).filter("least < most")
    late = open_rows.join(least.select("w1", "w2", "least"), ["w1", "w2"]).filter("least < first").select("string", "place", "stop")
    late = late.union(found.filter(F.col("kind") == EARLIER).select("string", "place", "stop"))
    late = late.withColumn("first", F.lit(None).cast("long"))
    whole = found.filter(F.col("kind") == WHOLE).select(
        "string", F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("stop"), "first")
    verdicts = late.union(whole).groupBy("string").agg(
        F.min("first").alias("first"), F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "stop"))).alias("earlier"))
    placed = supers.select("row", "doc_id", "start", "n", "string").join(saved(verdicts), "string")
    later = "first IS NOT NULL AND first < doc_id"
    all_of = placed.filter(later).selectExpr("row", "start", "start + n AS stop")
    some = placed.filter(f"NOT ({later})").selectExpr("row", "start", "explode(earlier) AS e")
    return all_of.union(some.selectExpr("row", "start + e.place AS start", "start + e.stop AS stop"))


def removed_words(docs: DataFrame, window: int = WINDOW, size: int = MINIMISER) -> DataFrame:
    """row, ``cuts``: by row key the runs (start, stop) of words to remove, sorted and apart."""
    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found = saved(document_minimisers(named, window, size))
    supers = saved(super_kmers(named, shared_minimisers(found), window, size))
    cuts = earlier_windows(supers, window).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    return cuts.select("row", F.transform("cuts", lambda c: F.struct(
        c["start"].alias("start"), (c["stop"] + window - 1).alias("stop"))).alias("cuts"))


def without(text: str, cuts) -> tuple[str, int, int]:
    """(what is left, number of words, removed ones): the words of the sorted ``cuts`` go with the white space behind them."""
    data = text.encode()
    starts, ends = word_bounds(data)
    n = len(starts)
    out, at, removed, upto = [], 0, 0, 0
    begins = np.append(starts, len(data))
    for start, stop in cuts:
        start = max(start, upto)
        if stop <= start:
            continue
        out.append(data[at:begins[start]])
        at, upto = int(begins[stop]), stop
        removed += stop - start
    out.append(data[at:])
    return b"".join(out).decode(), n, removed


def deduplicate(docs: DataFrame, window: int = WINDOW, size: int = MINIMISER, name: str = "_cut") -> DataFrame:
    """``docs`` with the repeated passages cut from ``text``, and struct ``name`` (n_words, n_removed).

    Words are the runs without ASCII white space. Each word under a window of ``window`` words
    whose word sequence also starts in a document with a smaller doc_id is removed, with the white
    space behind it; everything else of a text stays as it is. Windows are judged on the input.
    A column ``name`` of ``docs`` is replaced. Every row stays, repeated ones too (equal ids are not smaller). Rows without a doc_id are
    neither cut nor a reason to cut. Null texts stay null, with no words. Documents and windows
    are matched by 64 and 128 bits of hash.
    """
    docs = docs.drop(name)
    columns = docs.columns
    at = columns.index("text")
    cuts = removed_words(docs, window, size)
    row, own = fresh(docs, "row"), fresh(docs, "cuts")
    joined = (docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), row_key()))
              .join(cuts.toDF(row, own), row, "left").select(*[f"`{c}`" for c in columns], f"`{own}`"))
    out = docs.sparkSession.createDataFrame([], f"`{name}` struct<n_words: long, n_removed: long>").schema
    schema = type(docs.schema)(docs.schema.fields + out.fields)

    def cut(batches):
        from linesieve.llm.common import arrow_schema
        types = arrow_schema(schema)
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            made = [without(t or "", [(c["start"], c["stop"]) for c in own or ()]) for t, own in
                    zip(texts, batch.column(len(columns)).to_pylist())]
            arrays = list(batch.columns[:len(columns)])
            arrays[at] = pa.array([None if t is None else m[0] for t, m in zip(texts, made)], types.field(at).type)
            arrays.append(pa.array([{"n_words": n, "n_removed": r} for _, n, r in made], types.field(len(columns)).type))
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, types)], schema=types)

    return joined.mapInArrow(cut, schema)


def deduplicate_documents(docs: DataFrame, window: int = WINDOW, size: int = MINIMISER) -> DataFrame:
    """``deduplicate`` with the columns of ``docs``; where a text was cut, ``n_chars`` is its new length."""
    name = fresh(docs, "cut")
    cut = deduplicate(docs, window, size, name)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(name)["n_removed"] > 0, F.length("text")).otherwise(F.col("n_chars"))
                             .cast(docs.schema["n_chars"].dataType))
    return cut.select(*[f"`{c}`" for c in docs.columns])
