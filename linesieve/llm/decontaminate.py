"""Benchmark decontamination: every occurrence of a benchmark window in a document, by Wu-Manber search over words.

Patterns are the windows of the benchmark's items, grouped by their number of words. For each group
a shift table says, for the hash of a block of words, how many words a search may skip because no
window holds that block nearer to its end. Where the shift is zero, the suffix's bucket selects the
windows to test, and a direct comparison of their bytes confirms them. Many search positions, one
for each lane of a text, move at once.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.llm.common import fresh, map_texts, saved

WINDOW = 10
#: Words of a block of the shift tables.
BLOCK = 2
SHIFT_BITS = 20
#: Bytes of normalised text that are searched at once.
HELPING = 1 << 20
#: Windows whose hashes are taken at once.
TABLED = 1 << 13
#: Words of a lane.
LANE = 256
#: Bytes of windows that one pass over the documents searches for; a larger benchmark takes several passes.
PASS_BYTES = 1 << 25

#: A-Z to a-z; every other byte that is no word character (00-2F, 3A-60, 7B-7F) to a space.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
#: A word between two texts; no window holds it.
BETWEEN = b"\x00"

_FACTOR = 0x9E3779B97F4A7C15  # odd, so its powers have inverses modulo 2^64
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z lowered, as UTF-8."""
    return (text or "").encode().translate(NORMAL).split()


def windows_of(text: str | None, window: int = WINDOW) -> list[bytes]:
    """The distinct windows of an item, words joined by spaces; an item of fewer words is one window."""
    words = words_of(text)
    return list(dict.fromkeys(b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1)))) if words else []


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Text:
    """Normalised text, words joined by single spaces, with a hash for any run of its words."""

    def __init__(self, joined: bytes):
        self.data = joined
        points = np.frombuffer(joined, np.uint8)
        ends = np.flatnonzero(points == 32)
        self.starts = np.append(0, ends + 1)
        self.ends = np.append(ends, len(points))
        up, self._down = _powers(_FACTOR, len(points) + 1), _powers(_INVERSE, len(points) + 1)
        self._sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self._sums[1:])

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A 64-bit hash of words ``first`` to ``last``, for arrays of both."""
        a, b = self.starts[first], self.ends[last]
        x = (self._sums[b] - self._sums[a]) * self._down[a]
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Matcher:
    """Wu-Manber tables of the windows of one length in words."""

    def __init__(self, size: int, windows: list[tuple[bytes, int]]):
        self.size, self.block = size, min(BLOCK, size)
        self.shift = np.full(1 << SHIFT_BITS, size - self.block + 1, np.int32)
        keys = []
        for at in range(0, len(windows), TABLED):
            own = windows[at:at + TABLED]
            text = Text(b" ".join(w for w, _ in own))
            first = np.arange(len(own)) * size
            for ahead in range(size - self.block + 1):  # words between a block and the end of its window
                stop = first + size - ahead
                slot = self._slot(text.hashes(stop - self.block, stop - 1))
                np.minimum.at(self.shift, slot, ahead)
                if not ahead:
                    keys.append(self._key(slot, text.hashes(first, first + size - 1)))
        # Buckets of suffixes, their windows in the order of their hashes: one sorted key for both.
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.keys = key[order]
        self.windows = [windows[i] for i in order.tolist()]

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)

    @staticmethod
    def _key(slot: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return (slot.astype(np.uint64) << np.uint64(64 - SHIFT_BITS)) | (whole >> np.uint64(SHIFT_BITS))

    def last_words(self, text: Text) -> np.ndarray:
        """Words at which a window may end: those whose block has no shift."""
        n = len(text.starts)
        if n < self.size:
            return np.zeros(0, np.int64)
        at = np.arange(self.size - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        found = []
        while len(at):
            slot = self._slot(text.hashes(at - self.block + 1, at))
            step = self.shift[slot].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.concatenate(found)

    def find(self, text: Text):
        """(first word, last word, number of the window's text) of every occurrence."""
        last = self.last_words(text)
        first = last - self.size + 1
        key = self._key(self._slot(text.hashes(last - self.block + 1, last)), text.hashes(first, last))
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        some = np.flatnonzero(high > low)
        for a, b, lo, hi in zip(first[some].tolist(), last[some].tolist(), low[some].tolist(), high[some].tolist()):
            seen = text.data[text.starts[a]:text.ends[b]]
            for k in range(lo, hi):
                if self.windows[k][0] == seen:
                    yield a, b, self.windows[k][1]


class Search:
    """Matchers for all windows (window, items) of a pass."""

    def __init__(self, rows: pa.Table):
        items: dict[bytes, set] = {}
        for window, item in zip(rows["window"].to_pylist(), rows["item"].to_pylist()):
            items.setdefault(window.encode(), set()).add(item)
        self.items = list(items.values())
        groups: dict[int, list] = {}
        for number, window in enumerate(items):
            groups.setdefault(window.count(b" ") + 1, []).append((window, number))
        self.matchers = [Matcher(size, own) for size, own in sorted(groups.items())]
        self.longest = max(groups, default=0)

    def scan(self, texts: list[str]):
        """For each text: number of words, sorted runs (start, stop) of words that are hit, items with occurring windows."""
        held, size, first = [], 0, 0
        for i, text in enumerate(texts):
            data = b" ".join(words_of(text))
            if len(data) > HELPING:
                yield from self._helping(held)
                held, size = [], 0
                yield self._long(data)
                continue
            held.append(data)
            size += len(data) + 3
            if size >= HELPING:
                yield from self._helping(held)
                held, size = [], 0
        yield from self._helping(held)

    def _helping(self, held: list[bytes]):
        if not held:
            return
        text = Text((b" " + BETWEEN + b" ").join(d or BETWEEN for d in held))
        words = np.fromiter((d.count(b" ") + 1 for d in held), np.int64, len(held))
        begin = np.cumsum(words + 1) - words - 1
        runs, numbers = [[] for _ in held], [set() for _ in held]
        for matcher in self.matchers:
            found = list(matcher.find(text))
            of = np.searchsorted(begin, [a for a, _, _ in found], side="right") - 1
            for i, (a, b, number) in zip(of.tolist(), found):
                at = int(begin[i])
                runs[i].append((a - at, b + 1 - at))
                numbers[i].add(number)
        for data, n, own, seen in zip(held, words.tolist(), runs, numbers):
            yield n if data else 0, joined_runs(own), self._named(seen)

    def _long(self, data: bytes):
        """A long text in helpings that overlap by the longest window less a word."""
        runs, seen, before, at = [], set(), 0, 0
        while True:
            end = len(data)
            if at + HELPING < end:
                end = data.find(b" ", at + HELPING)
                end = len(data) if end < 0 else end
            text = Text(data[at:end])
            for matcher in self.matchers:
                for a, b, number in matcher.find(text):
                    runs.append((before + a, before + b + 1))
                    seen.add(number)
            n = len(text.starts)
            runs = joined_runs(runs)
            if end == len(data):
                return before + n, runs, self._named(seen)
            again = min(max(self.longest - 1, 0), n - 1)  # words that the next helping reads once more
            before += n - again
            at = at + int(text.starts[n - again]) if again else end + 1

    def _named(self, numbers: set[int]) -> list[str]:
        return sorted({item for k in numbers for item in self.items[k] if item is not None})


def joined_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order; those that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (window, item): every window of every item, the item's id as a string."""

    def kernel(texts):
        made = [windows_of(t, window) for t in texts]
        bounds = pa.array(np.cumsum([0, *map(len, made)]), pa.int32())
        return [pa.ListArray.from_arrays(bounds, pa.array([w.decode() for own in made for w in own], pa.string()))]

    named = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))
    return map_texts(named, kernel, "own array<string>", "text", ["item"]).select(F.explode("own").alias("window"), "item").distinct()


FIELDS = "n_words long, hit array<struct<start: long, stop: long>>, items array<string>"


def _scanned(docs: DataFrame, search, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and FIELDS of every row; ``search`` is a broadcast table of (window, item)."""
    tables = []

    def kernel(texts):
        if not tables:
            tables.append(Search(search.value))
        rows = list(tables[0].scan(texts))
        runs = [r[1] for r in rows]
        flat = np.array([x for own in runs for x in own], np.int64).reshape(-1, 2)
        pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "stop"])
        bounds = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        return [pa.array([r[0] for r in rows], pa.int64()), pa.ListArray.from_arrays(bounds, pairs),
                pa.array([r[2] for r in rows], pa.list_(pa.string()))]

    return map_texts(docs, kernel, FIELDS, text, keep)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, text: str = "text",
                  item: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Columns ``keep`` of every row of ``docs``, with n_words, ``hit`` (runs of hit words) and ``items``.

    A word is hit if an occurrence of a window of the benchmark covers it. ``items`` are the ids, as
    strings, of the items with an occurring window, each once, in string order; an item without an
    id still hits words. Null and empty texts have no words; a benchmark without words hits none.
    Rows that repeat are judged one by one, none is dropped; columns not in ``keep`` take no part,
    and a kept column named like a result gives way to it.

    The windows are sent to the tasks in passes of at most about ``pass_bytes`` bytes: one pass,
    without a shuffle, for an ordinary benchmark; for a larger one a pass each for random parts of
    the windows, whose hits are put together by row.
    """
    spark = docs.sparkSession
    patterns = saved(windows(benchmark, window, item, item_text))
    total = patterns.agg(F.sum(F.octet_length("window") + 64)).first()[0] or 0
    passes = -(-total // pass_bytes) or 1

    def search(number):
        own = patterns.filter(F.pmod(F.xxhash64("window", "item"), F.lit(passes)) == number)
        return spark.sparkContext.broadcast(own.toArrow())

    if passes == 1:
        return _scanned(docs, search(0), text, keep)
    uid = fresh(docs, "uid")
    numbered = saved(docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])]).withColumn(uid, F.monotonically_increasing_id()))
    parts = []
    for number in range(passes):
        sent = search(number)
        parts.append(saved(_scanned(numbered, sent, text, [uid])))
        sent.destroy()
    both = parts[0]
    for part in parts[1:]:
        both = both.union(part)
    merged = both.groupBy(uid).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit")).alias("hit"),
                                   F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.withColumn("hit", _joined(F.sort_array("hit")))
    own = [c for c in keep if c not in ("n_words", "hit", "items")]
    return numbered.select(uid, *[f"`{c}`" for c in own]).join(merged, uid).drop(uid)


def _joined(runs: F.Column) -> F.Column:
    """Sorted runs (start, stop); those that overlap or touch become one."""
    return F.aggregate(
        runs, F.expr("CAST(array() AS array<struct<start: bigint, stop: bigint>>)"),
        lambda out, r: F.when((F.size(out) > 0) & (r["start"] <= F.try_element_at(out, F.lit(-1))["stop"]), F.concat(
            F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))),
            F.array(F.struct(F.try_element_at(out, F.lit(-1))["start"].alias("start"),
                             F.greatest(F.try_element_at(out, F.lit(-1))["stop"], r["stop"]).alias("stop")))))
        .otherwise(F.concat(out, F.array(r))))


def without_hits(text: str, runs) -> str:
    """``text`` without the words of ``runs``; what stands between words stays as it is."""
    data = text.encode()
    kind = np.frombuffer(data.translate(NORMAL), np.uint8) != 32
    steps = np.diff(np.concatenate([[0], kind.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    gone = np.zeros(len(data) + 1, np.int64)
    for start, stop in runs:
        gone[starts[start]] += 1
        gone[ends[stop - 1]] -= 1
    return np.frombuffer(data, np.uint8)[np.cumsum(gone[:-1]) == 0].tobytes().decode()

