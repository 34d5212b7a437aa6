"""Spelling variants: words of the corpus that differ by one character, by search in bidirectional FM-indexes.

Of two words that differ by one inserted, deleted or replaced character, one half of either stands
unchanged in the other, at its beginning or its end. A search scheme matches that half exactly,
from the middle outward to the delimiter, then turns and extends across the other half, allowing
one error, down to the other delimiter. The words of the index are delimited, and every state of a
search is an interval of suffix ranks, kept for the text and its mirror image together.

The index is dealt out by halves: a word goes to the cells of those of its beginnings and ends that
can be the half of a word one character longer, shorter or as long. Each cell holds an index of a
bounded number of words; a half that more words share gets several cells, and its searches visit all.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.llm.common import saved, sliced

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: One run in so many of a document loses a character.
PLANTED = 97
#: Words of a cell's index, and searches that go through it at once.
CELL = 1 << 12
SEARCHES = 1 << 12

_RUN = re.compile("[a-zÀ-ÿ]+")


def planted_word(doc_id: int | None, run: str) -> str:
    """The run without its character number h % length, where h, the crc32 of ``<doc_id>:<run>``, is a multiple of PLANTED."""
    if doc_id is None:
        return run
    h = zlib.crc32(run.encode(), zlib.crc32(b"%d:" % doc_id))
    if h % PLANTED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", change=planted_word, least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts and how often they occur.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lowered, passed through
    ``change(doc_id, run)`` if there is one. A task counts each slice of texts before they travel.
    """

    def count(batches):
        for batch in sliced(batches):
            counts: Counter = Counter()
            for own, t in zip(*[c.to_pylist() for c in batch.columns]):
                if t is None:
                    continue
                for run, n in Counter(_RUN.findall(t.encode().lower().decode())).items():
                    if len(run) >= least_length:
                        word = change(own, run) if change else run
                        if len(word) >= least_length:
                            counts[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    source = docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string"))
    return source.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Side:
    """One direction of an index: the cyclic text's last column as ranks of every symbol at every place."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        rank, step = text.astype(np.int64), 1
        while True:  # doubling; the words differ, so all rotations do
            key = rank * (n + symbols) + np.roll(rank, -step)
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
            if rank[order[-1]] == n - 1:
                break
            step *= 2
        self.order = order
        last = text[order - 1]
        # below[i, c]: symbols less than c among the first i of the last column.
        self.below = np.zeros((n + 1, symbols + 1), np.int32)
        hot = np.zeros((n, symbols), np.int32)
        hot[np.arange(n), last] = 1
        np.cumsum(np.cumsum(hot, axis=0), axis=1, out=self.below[1:, 1:])
        self.first = self.below[n].astype(np.int64)

    def step(self, low, high, symbol):
        """New interval after one more symbol in front, and how far the mirror's interval moves up; arrays all."""
        less_low, less_high = self.below[low, symbol], self.below[high, symbol]
        in_low, in_high = self.below[low, symbol + 1] - less_low, self.below[high, symbol + 1] - less_high
        begin = self.first[symbol]
        return begin + in_low, begin + in_high, (less_high - less_low).astype(np.int64)

    def symbols(self, low, high) -> np.ndarray:
        """Which symbols stand in front, (intervals, symbols)."""
        return np.diff(self.below[high] - self.below[low], axis=1) > 0


class Index:
    """A bidirectional FM-index of distinct words. Symbol 0 delimits them; unknown characters have the last symbol, which never occurs."""

    def __init__(self, words: list[str]):
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.alphabet = np.unique(np.concatenate(points))
        self.symbols = len(self.alphabet) + 2
        begin = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(int(lengths.sum()) + len(words), np.int64)
        text[np.delete(np.arange(len(text)), begin)] = np.searchsorted(self.alphabet, np.concatenate(points)) + 1
        self.forward, self.mirror = Side(text, self.symbols), Side(text[::-1], self.symbols)
        self.word_at = np.zeros(len(text), np.int64)
        self.word_at[begin] = np.arange(len(words))

    def coded(self, words: list[str]) -> np.ndarray:
        """The words' symbols as rows of a matrix, ended by delimiters."""
        width = max(map(len, words)) + 1
        out = np.zeros((len(words), width), np.int64)
        for i, word in enumerate(words):
            points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
            at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
            out[i, :len(word)] = np.where(self.alphabet[at] == points, at + 1, self.symbols - 1)
        return out

    def extend(self, state, symbol, left: bool):
        """States (low, low in the mirror, size) after one more symbol on the left or right, and which of them are not empty."""
        low, mirrored, size = state
        side, a, b = (self.forward, low, mirrored) if left else (self.mirror, mirrored, low)
        new, end, up = side.step(a, a + size, symbol)
        made = (new, b + up, end - new) if left else (b + up, new, end - new)
        return made, np.flatnonzero(end > new)

    def in_front(self, state, left: bool) -> np.ndarray:
        low, mirrored, size = state
        return self.forward.symbols(low, low + size) if left else self.mirror.symbols(mirrored, mirrored + size)

    def near(self, words: list[str], beginning: bool):
        """(number of the searched word, number of the index word): all pairs that differ by one character, where the index
        word shares the searched word's first half (``beginning``) or else its second half."""
        code = self.coded(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        half = lengths // 2
        kept, other = (half, lengths - half) if beginning else (lengths - half, half)
        lane = np.arange(len(words))
        n = len(self.word_at)
        state = (np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), n))

        def symbol_of(lane, k, exact):
            """Symbol number ``k`` of a half, counted from the middle; behind its end the delimiter."""
            toward_left = beginning == exact  # the kept beginning is read leftward, and so is the other half of a kept end
            own = (kept if exact else other)[lane]
            at = half[lane] - 1 - k if toward_left else half[lane] + k
            return np.where(k < own, code[lane, np.clip(at, 0, code.shape[1] - 1)], 0)

        def taken(state, lane, *rest, at):
            return tuple(x[at] for x in state), lane[at], *[x[at] for x in rest]

        # The kept half, from the middle to its delimiter.
        done = []
        for k in range(int(kept.max()) + 1):
            state, on = self.extend(state, symbol_of(lane, k, True), beginning)
            state, lane = taken(state, lane, at=on)
            ended = kept[lane] == k
            done.append(taken(state, lane, at=ended))
            state, lane = taken(state, lane, at=~ended)
        exact = tuple(np.concatenate(x) for x in zip(*[d[0] for d in done]))
        exact_lane = np.concatenate([d[1] for d in done])

        # The other half: lanes without an error, and lanes with one, by the number of symbols read.
        left = not beginning
        pairs = []
        err_state, err_lane, err_read = tuple(x[:0] for x in exact), exact_lane[:0], exact_lane[:0]
        for k in range(int(other.max()) + 1):
            # An error here: every symbol in front, as an inserted or a replaced one; or the word's own symbol left out.
            lanes, symbols = np.nonzero(self.in_front(exact, left)[:, 1:]) if len(exact_lane) else (exact_lane, exact_lane)
            symbols = symbols + 1
            made, _ = self.extend(tuple(x[lanes] for x in exact), symbols, left)
            own, of = exact_lane[lanes], symbol_of(exact_lane[lanes], k, False)
            replaced = (k < other[own]) & (symbols != of)
            dropped = k < other[exact_lane]
            new = [(made, own, np.full(len(own), k)),
                   (tuple(x[replaced] for x in made), own[replaced], np.full(int(replaced.sum()), k + 1)),
                   (tuple(x[dropped] for x in exact), exact_lane[dropped], np.full(int(dropped.sum()), k + 1))]
            err_state = tuple(np.concatenate(x) for x in zip(err_state, *[s for s, _, _ in new]))
            err_lane = np.concatenate([err_lane, *[x for _, x, _ in new]])
            err_read = np.concatenate([err_read, *[x for _, _, x in new]])
            # Lanes that have read k symbols read the next one, which is the delimiter behind the last.
            now = err_read == k
            held = taken(err_state, err_lane, err_read, at=~now)
            state, lane, read = taken(err_state, err_lane, err_read, at=now)
            state, on = self.extend(state, symbol_of(lane, k, False), left)
            state, lane, read = taken(state, lane, read, at=on)
            ended = other[lane] == k
            pairs.append((lane[ended], self._word(taken(state, lane, at=ended)[0], left)))
            state, lane, read = taken(state, lane, read + 1, at=~ended)
            err_state = tuple(np.concatenate(x) for x in zip(held[0], state))
            err_lane, err_read = np.concatenate([held[1], lane]), np.concatenate([held[2], read])
            # Lanes without an error go on; a word without any is the searched word itself.
            more = other[exact_lane] > k
            exact, exact_lane = taken(exact, exact_lane, at=more)
            exact, on = self.extend(exact, symbol_of(exact_lane, k, False), left)
            exact, exact_lane = taken(exact, exact_lane, at=on)
        lanes, found = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        return np.unique(np.stack([lanes, found]), axis=1)

    def _word(self, state, left: bool) -> np.ndarray:
        """Numbers of the index words of states that hold a whole word with both delimiters."""
        return self.word_at[self.forward.order[state[0]]]


HIT_FIELDS = "word string, near long, best struct<less: long, form: string>"
_HITS = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best", pa.struct([("less", pa.int64()), ("form", pa.string())]))])


def _cell(table: pa.Table) -> pa.Table:
    """A cell's searches against its index: for each searched word the number of near words and the best of them.

    A word comes by several of its halves; the index holds it once.
    """
    held = table.filter(pc.invert(table["search"])).group_by(["word", "n"]).aggregate([]).sort_by("word")
    asked = table.filter(table["search"]).group_by(["word", "beginning"]).aggregate([])
    words, counts = held["word"].to_pylist(), held["n"].to_numpy()
    made = []
    if len(words) > 1 and len(asked):
        index = Index(words)
        for beginning in (True, False):
            own = asked.filter(pc.equal(asked["beginning"], beginning))["word"].to_pylist()
            for at in range(0, len(own), SEARCHES):
                made.append(_best_of(index, words, counts, own[at:at + SEARCHES], beginning))
    return pa.Table.from_batches(made, _HITS)


def _best_of(index: Index, words: list[str], counts: np.ndarray, own: list[str], beginning: bool) -> pa.RecordBatch:
    lanes, found = index.near(own, beginning)
    if not beginning:  # a pair that shares the first half, too, is found by that search
        halves = [w[:len(w) // 2] for w in own]
        new = np.fromiter((not words[b].startswith(halves[a]) for a, b in zip(lanes.tolist(), found.tolist())), bool, len(lanes))
        lanes, found = lanes[new], found[new]
    order = np.lexsort((found, -counts[found], lanes))  # numbers of words are in code-point order
    lanes, found = lanes[order], found[order]
    head = np.flatnonzero(np.append(True, np.diff(lanes) != 0)) if len(lanes) else lanes
    best = [{"less": -int(counts[w]), "form": words[w]} for w in found[head].tolist()]
    return pa.RecordBatch.from_pydict({"word": [own[i] for i in lanes[head].tolist()], "near": np.diff(np.append(head, len(lanes))),
                                       "best": best}, schema=_HITS)


def _half(side: bool, shift: int) -> F.Column:
    """The beginning or end of ``word`` that would be the half of a word ``shift`` characters longer."""
    size = f"length(word) + {shift}"
    part = f"left(word, ({size}) DIV 2)" if side else f"right(word, {size} - ({size}) DIV 2)"
    return F.struct(F.lit(side).alias("beginning"), F.expr(part).alias("part"))


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """word, ``near`` and ``best`` (-n, form): how many of ``words`` (word, n; distinct) differ from one by a single character, and
    the most frequent of them, ties to the smallest. Words without such a neighbour have no row."""
    ends = F.array_distinct(F.array(*[_half(side, shift) for shift in (-1, 0, 1) for side in (True, False)]))
    halves = F.array(_half(True, 0), _half(False, 0))
    rows = [words.select("word", "n", F.lit(search).alias("search"), F.explode(keys).alias("key")).select("key.*", "search", "word", "n")
            for search, keys in ((False, ends), (True, halves))]
    both = saved(rows[0].union(rows[1]))
    sizes = both.groupBy("beginning", "part").agg(F.count_if(~F.col("search")).alias("held"), F.count_if("search").alias("asked"))
    # A half that only one word has needs no search. One with more than a cell of words is dealt to a
    # grid: parts of its words by parts of its searches.
    spread = saved(sizes.filter("asked > 0 AND held > 1").select(
        "beginning", "part", "held", F.expr(f"(held + {cell - 1}) DIV {cell}").alias("rows"),
        F.expr(f"(asked + {4 * cell - 1}) DIV {4 * cell}").alias("columns")))
    cells = max(1, -(-(spread.agg(F.sum("held")).first()[0] or 0) // cell))
    placed = both.join(spread, ["beginning", "part"]).withColumn(
        "own", F.pmod(F.xxhash64("word"), F.when(F.col("search"), F.col("columns")).otherwise(F.col("rows")))).withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("search"), F.col("rows")).otherwise(F.col("columns")) - 1)))
    row = F.when(F.col("search"), F.col("copy")).otherwise(F.col("own"))
    column = F.when(F.col("search"), F.col("own")).otherwise(F.col("copy"))
    alone = F.expr("rows = 1 AND columns = 1")
    number = F.when(alone, F.pmod(F.xxhash64("beginning", "part"), F.lit(cells))).otherwise(F.xxhash64("beginning", "part", row, column))
    dealt = placed.select(number.alias("cell"), alone.alias("alone"), "search", "beginning", "word", "n")
    found = dealt.groupBy("cell", "alone").applyInArrow(_cell, HIT_FIELDS)
    return found.groupBy("word").agg(F.sum("near").alias("near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word, ``root``: the last word that is reached from each word of ``links`` (word, form), which hold no cycle.

    Every round doubles the steps taken, so the rounds are the logarithm of the longest chain.
    """
    state = saved(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = saved(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not state.filter("moved").limit(1).count():
            return state.select("word", "root")
        state = state.select("word", "root")


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", change=planted_word, least_length: int = LEAST_LENGTH,
             least_count: int = LEAST_COUNT, cell: int = CELL) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus that is long and frequent enough.

    ``n_near`` words differ from a word by one inserted, deleted or replaced character; its form is
    the most frequent of them, ties to the smallest in code-point order, if it is at least twice as
    frequent. Forms lead on to ``root``, the word itself if it has none: counts double at every
    step, so there are no cycles. Null texts have no words; a null doc_id plants no change. Rows
    that repeat count again; other columns take no part; an empty table gives an empty result.
    """
    words = saved(vocabulary(docs, text, doc_id, change, least_length, least_count))
    joined = words.join(near_words(words, cell), "word", "left")
    formed = F.expr("-best.less >= 2 * n")
    listed = saved(joined.select("word", "n", F.coalesce("near", F.lit(0).cast("long")).alias("n_near"),
                                 F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")))
    last = roots(listed.filter("form IS NOT NULL"))
    return listed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
