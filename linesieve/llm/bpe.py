"""Byte-level BPE: texts to ids by a rank file, and ids back to bytes.

The text is cut by ``pretoken`` (class arrays and a scan of transition functions), every distinct slice
is looked up among the slices met before, and only a new one is merged pair by pair. Decoding
gathers the vocabulary's bytes by id.
"""

import base64
import hashlib
import heapq
from collections import defaultdict
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linesieve.llm.common import map_texts, ragged_take
from linesieve.llm.pretoken import TIKTOKEN, cuts

#: Slices remembered by a task; when so many are known, all are forgotten.
KNOWN_PIECES = 600_000
#: Slices of more bytes are merged with a heap.
LONG_PIECE = 64
#: Slices of one length that are merged at once.
MERGE_ROWS = 1 << 14
NO_PAIR = np.iinfo(np.int32).max


@cache
def vocabulary(path: str):
    """Rank by bytes, and all token bytes in one array with their starts and lengths."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    by_id = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        by_id[rank] = word
    lengths = np.array([len(w) for w in by_id], np.int64)
    return ranks, np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(lengths) - lengths, lengths


@cache
def _pairs(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of ids whose bytes together are a token: sorted keys (left id, right id) and that token's rank."""
    ranks = vocabulary(path)[0]
    found = [(ranks[word[:i]] << 32 | ranks[word[i:]], rank) for word, rank in ranks.items()
             for i in range(1, len(word)) if word[:i] in ranks and word[i:] in ranks]
    keys, values = np.array(sorted(found), np.int64).reshape(-1, 2).T
    return np.ascontiguousarray(keys), np.append(values, NO_PAIR).astype(np.int32)


def merge_all(words: list[bytes], path: str) -> list[list[int]]:
    """Ids of each slice: its pair of lowest rank, leftmost first, is merged until none is left.

    Slices of one length are merged together, one merge of each in a round, as rows of a matrix.
    """
    ranks = vocabulary(path)[0]
    out = [[whole] if (whole := ranks.get(w)) is not None else None for w in words]
    by_length = defaultdict(list)
    for k, w in enumerate(words):
        if out[k] is None:
            if len(w) > LONG_PIECE:
                out[k] = _merge_long(w, ranks)
            else:
                by_length[len(w)].append(k)
    for length, members in by_length.items():
        for at in range(0, len(members), MERGE_ROWS):
            own = members[at:at + MERGE_ROWS]
            for k, ids in zip(own, _merge_rows([words[k] for k in own], length, path)):
                out[k] = ids
    return out


def _merge_rows(words: list[bytes], length: int, path: str):
    ranks = vocabulary(path)[0]
    keys, values = _pairs(path)
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    rows = len(words)
    # One more column at the end holds no token; pairs with it have no rank.
    token = np.full((rows, length + 1), -1, np.int64)
    token[:, :length] = single[np.frombuffer(b"".join(words), np.uint8).reshape(rows, length)]
    before = np.tile(np.arange(-1, length, dtype=np.int64), (rows, 1))
    after = np.tile(np.arange(1, length + 2, dtype=np.int64), (rows, 1))
    after[:, length] = length

    def rank_of(left, right):
        key = left << 32 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (left >= 0) & (right >= 0), values[at], NO_PAIR)

    rank = np.full((rows, length + 1), NO_PAIR, np.int32)
    rank[:, :length] = rank_of(token[:, :-1], token[:, 1:])
    alive = np.ones((rows, length), bool)
    live = np.arange(rows)
    while len(live):
        i = rank[live].argmin(axis=1)
        low = rank[live, i]
        live, i, low = live[low < NO_PAIR], i[low < NO_PAIR], low[low < NO_PAIR]
        j = after[live, i]
        token[live, i] = low
        token[live, j] = -1
        alive[live, j] = False
        rank[live, j] = NO_PAIR
        k = after[live, j]
        after[live, i] = k
        before[live, k] = i
        rank[live, i] = rank_of(token[live, i], token[live, k])
        h = before[live, i]
        has = h >= 0
        rank[live[has], h[has]] = rank_of(token[live[has], h[has]], token[live[has], i[has]])
    left = token[:, :length][alive].tolist()
    bounds = np.cumsum(np.append(0, alive.sum(axis=1))).tolist()
    return [left[a:b] for a, b in zip(bounds, bounds[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n steps, with a linked list of spans and a heap of pairs."""
    n = len(piece)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = []

    def offer(i):
        j = after[i]
        if j < n and (rank := ranks.get(piece[i:ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue
        ends[i], after[i], alive[j] = end, after[j], False
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:ends[i]]])
        i = after[i]
    return out


class Pieces(dict):
    """From a slice to its number; a slice not met before gets the next one. ``encode`` merges the new ones.

    ``merged(list of new slices)`` returns their ids, a list for each.
    """

    def __init__(self, merged):
        super().__init__()
        self.merged = merged
        self.forget()

    def forget(self):
        self.clear()
        self.new = []
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = number = len(self)
        return number

    def encode(self, slices: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the slices, one after the other, and how many each slice has."""
        if len(self) > KNOWN_PIECES:
            self.forget()
        found = slices.dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))[found.indices.to_numpy()]
        if self.new:
            ids = self.merged(self.new)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.flat = np.append(self.flat, np.array(list(chain.from_iterable(ids)), np.uint32))
            self.new = []
        lengths = self.lengths[numbers]
        return ragged_take(self.flat, self.starts[numbers], lengths), lengths


def grouped(texts: list[str], library: str, size: int = 1 << 20):
    """``cuts`` in larger helpings."""
    spans, parts, n = [], [], 0
    for own, slices in cuts(texts, library):
        spans += own
        parts.append(slices)
        n += len(slices)
        if n >= size:
            yield spans, pa.concat_arrays(parts)
            spans, parts, n = [], [], 0
    if spans:
        yield spans, pa.concat_arrays(parts)


@cache
def _encoder(path: str) -> Pieces:
    return Pieces(lambda new: merge_all([s.encode() for s in new], path))


def encoded(texts: list[str], encoder: Pieces, library: str = TIKTOKEN):
    """Yields (index of the text, an array with its next ids), in order; every text comes at least once."""
    for spans, slices in grouped(texts, library):
        ids, lengths = encoder.encode(slices)
        ends = np.cumsum(lengths)
        at, seen = 0, 0
        for i, n in spans:
            seen += n
            end = int(ends[seen - 1]) if seen else 0
            yield i, ids[at:end]
            at = end


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``ids`` (array of int) of every text, and ``offsets``: where each id's bytes begin in the UTF-8 text.

    Null and empty texts have no ids. Columns ``keep`` go along, unless named like a result. Rows
    stay where they are, repeated rows included; an empty table gives an empty one.
    """

    def kernel(texts):
        _, _, _, sizes = vocabulary(path)
        own = [[] for _ in texts]
        for i, ids in encoded(texts, _encoder(path)):
            own[i].append(ids)
        ids = [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in own]
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
        bounds = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
        offsets = [np.cumsum(sizes[x]) - sizes[x] for x in ids]
        offsets = np.concatenate([*offsets, np.zeros(0, np.int64)])
        return (pa.ListArray.from_arrays(bounds, pa.array(flat.astype(np.int32))),
                pa.ListArray.from_arrays(bounds, pa.array(offsets.astype(np.int32))))

    return map_texts(docs, kernel, "ids array<int>, offsets array<int>", text, keep)


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """The bytes that ``ids`` stand for."""
    _, flat, starts, lengths = vocabulary(path)
    return ragged_take(flat, starts[ids], lengths[ids]).tobytes()


def decode(rows: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``decoded`` (binary) of every row's array of ids; null gives no bytes."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    keep = [c for c in keep or [] if c != "decoded"]
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("decoded", T.BinaryType())])

    def batches(source):
        for batch in source:
            values = batch.column(len(keep)).to_pylist()
            made = pa.array([decode_ids(np.array(v or [], np.int64), path) for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], made], names=[*keep, "decoded"])

    return rows.select(*keep, F.col(ids).alias("_ids")).mapInArrow(batches, schema)


@cache
def _decimals(path: str):
    """Every id as decimal digits and a comma: all bytes in one array, with starts and lengths."""
    n = len(vocabulary(path)[3])
    words = [b"%d," % i for i in range(n)]
    lengths = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths


def round_trip_digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encodes every whole text and decodes its ids again, keeping only digests of both.

    Gives ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256``
    (of the decoded bytes). Long texts pass through in parts, so memory is bounded by a part.
    Null and empty texts: no tokens and the digests of nothing.
    """

    def kernel(texts):
        digits, starts, lengths = _decimals(path)
        counts = [0] * len(texts)
        said, read = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for i, ids in encoded(texts, _encoder(path)):
            if len(ids):
                written = ragged_take(digits, starts[ids], lengths[ids])[:-1].tobytes()
                said[i].update(b"," + written if counts[i] else written)
                read[i].update(decode_ids(ids, path))
                counts[i] += len(ids)
        return counts, [h.hexdigest() for h in said], [h.hexdigest() for h in read]

    return map_texts(docs, kernel, "n_tokens long, ids_sha256 string, decoded_sha256 string", text, keep)
