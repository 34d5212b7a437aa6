"""Packing tokenised documents into sequences: first-fit decreasing in randomised groups.

A document's ids are cut into full sequences and a rest. The rests are dealt at random into
groups of bounded size; each group is packed on its own, longest rest first, into the leftmost
sequence with room, which a tournament tree over the capacities finds in logarithmic time.
"""

import json
import os
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.llm.bpe import Pieces, encoded
from linesieve.llm.common import saved, sliced
from linesieve.llm.pretoken import TOKENIZERS

SEQUENCE = 2048
#: Rests in a group, on average.
GROUP = 1 << 14
#: New slices that the library's model gets at once.
MODEL_SLICES = 1 << 12

PIECE_FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, uid long"


@cache
def _library(path: str):
    """The vocabulary's own library, and the slices of the pre-tokenisation that it has encoded before."""
    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for every core
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True  # strings of added tokens are cut out before, by ``document_ids``
    return own, Pieces(_model_ids(own) or (lambda new: [e.ids for e in own.encode_batch_fast(new, add_special_tokens=False)]))


def _model_ids(own):
    """A function from slices to their ids by the library's model alone, which gets many slices as one text of words.

    The characters that stand for bytes are put in before, and the ids go back to their slices by the number of bytes
    of each. None for files where this is not all that happens to a slice.
    """
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit
    file = json.loads(own.to_str())
    model, cut, signs = file["model"], file["pre_tokenizer"] or {}, sorted(map(ord, ByteLevel.alphabet()))
    if (model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or file["normalizer"] or any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
            or not all(chr(c) in model["vocab"] for c in signs)):
        return None
    sizes = np.zeros(max(model["vocab"].values()) + 1, np.int64)
    sizes[list(model["vocab"].values())] = list(map(len, model["vocab"]))
    plain = [c for c in signs if c < 256]  # these bytes stand for themselves, the others come in their order
    sign = np.zeros(256, "<u4")
    sign[plain] = plain
    sign[sign == 0] = signs[len(plain):]
    sign[0xFF] = ord(" ")  # a byte that no UTF-8 has, and a character that stands for none
    bare = Tokenizer(own.model)
    bare.pre_tokenizer = CharDelimiterSplit(" ")

    def ids_of(new: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(new), MODEL_SLICES):
            words = [s.encode() for s in new[at:at + MODEL_SLICES]]
            text = sign[np.frombuffer(b"\xff".join(words), np.uint8)].tobytes().decode("utf-32-le")
            ids = bare.encode_batch_fast([text], add_special_tokens=False)[0].ids
            ends = np.cumsum(sizes[ids])
            bounds = np.searchsorted(ends, np.cumsum([0, *map(len, words)]), side="right").tolist()
            out += [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    return ids_of


@cache
def _added(path: str):
    """The ids of the file's added tokens by their strings, the pattern of these, the longest first, and
    the library for files where a string alone does not tell a token: with marks for words, blanks or a normaliser."""
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(path)
    tokens = own.get_added_tokens_decoder()
    if any(t.single_word or t.lstrip or t.rstrip or (t.normalized and own.normalizer is not None) for t in tokens.values()):
        return {}, None, own
    ids = {t.content: number for number, t in tokens.items()}
    return ids, re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None, None


def document_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of the texts, as the vocabulary's library gives them without a setting changed.

    A string of an added token inside a text gets the token's id; what stands between is encoded on its own.
    """
    ids, pattern, whole = _added(path)
    if whole is not None:
        return [np.array(e.ids, "<u4") for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    if pattern is None:
        return token_ids(texts, path)
    plain, found = [], []
    for text in texts:
        at, own = 0, []
        for m in pattern.finditer(text):
            own.append(ids[m[0]])
            plain.append(text[at:m.start()])
            at = m.end()
        plain.append(text[at:])
        found.append(own)
    parts = iter(token_ids(plain, path))
    out = []
    for own in found:
        joined = [next(parts)]
        for number in own:
            joined += [np.array([number], "<u4"), next(parts)]
        out.append(np.concatenate(joined) if own else joined[0])
    return out


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of the texts, as the vocabulary's library gives them if strings of added tokens are ordinary text.

    Texts are cut by ``pretoken`` with the library's own classes of characters, and each new slice
    goes to the library's model once.
    """
    out = [[] for _ in texts]
    for i, ids in encoded(texts, _library(path)[1], TOKENIZERS):
        out[i].append(ids)
    return [np.concatenate([np.array(p, "<u4") for p in parts]) if parts else np.zeros(0, "<u4") for parts in out]


def tournament_pack(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """First-fit decreasing: (bin, offset) of every item. ``lengths`` are 1 to ``size``; equal ones go in their order."""
    n = len(lengths)
    width = 1 << max(n - 1, 0).bit_length()
    tree = [size] * (2 * width)  # the largest room below each node; leaf k is bin k
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[item]), 1
        while node < width:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[item], offsets[item] = node - width, size - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def cut_documents(docs: DataFrame, path: str, end_id: int = 1, size: int = SEQUENCE) -> DataFrame:
    """Every document's ids (``document_ids``) and ``end_id``, cut after each ``size`` ids: one row a piece, with a unique ``uid``.

    Columns doc_id, start, length, ids_crc32 (of the ids as little-endian 32 bits), doc_tokens, uid.
    A null or empty text is one piece of ``end_id`` alone. Repeated rows and null ids are kept.
    """
    schema = docs.sparkSession.createDataFrame([], PIECE_FIELDS).schema
    names = schema.names

    def cut(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), document_ids(texts, path)):
                ids = np.append(ids, np.array([end_id], "<u4"))
                for start in range(0, len(ids), size):
                    part = ids[start:start + size]
                    rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids), uid))
                    uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def pack(docs: DataFrame, path: str, end_id: int = 1, size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Packs all documents: the rows of ``cut_documents`` with ``sequence_id`` and ``offset``.

    Each sequence holds at most ``size`` ids without gaps. A full piece is a sequence of its own.
    The others are dealt to groups by a hash of their unique number, so neither a hot source nor
    repeated rows can fill a group; a group has about ``group`` rows at every size of input. Equal
    lengths go in the order of that hash. Null text: empty. An empty table gives an empty result;
    columns besides doc_id and text take no part.
    """
    cut = saved(cut_documents(docs, path, end_id, size))
    full = cut.filter(F.col("length") == size).select(
        "*", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = cut.filter(F.col("length") < size)
    n_groups = -(-rests.count() // group) or 1
    rests = rests.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(n_groups)))
    names = full.columns

    def packed(table: pa.Table) -> pa.Table:
        uid = table.column("uid").to_numpy()
        table = table.take(pa.array(np.argsort(_shuffled(uid), kind="stable")))
        uid, lengths = table.column("uid").to_numpy(), table.column("length").to_numpy()
        bins, offsets = tournament_pack(lengths, size)
        first = np.full(len(bins) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, bins, uid)
        return pa.table([*[table.column(c) for c in names[:-2]], pa.array(first[bins]), pa.array(offsets)], names=names)

    return full.unionByName(rests.groupBy("grp").applyInArrow(packed, full.schema))


def _shuffled(uid: np.ndarray) -> np.ndarray:
    from linesieve.llm.common import mix64
    return mix64(uid)
