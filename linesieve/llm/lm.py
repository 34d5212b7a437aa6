"""Scoring texts with a smoothed n-gram model, an automaton with weighted failure arcs.

States are what a text has just said, from the last ``order`` - 1 words down to a root that
remembers nothing. An n-gram seen in training is an arc from the state of all its words but the
last. A state without an arc for the next word fails to the state of one word less, at the price
that Dirichlet smoothing gives, and so on down to the root, which knows every word. A text is read
once, left to right, carrying its state and adding up log-probabilities.

The model of a large corpus fits no machine. Documents stand in blocks of bounded size; each block
asks for the counts of just the n-grams that occur in it. The questions are dealt by a hash of the
n-gram, counted there over all blocks, and the answers go back to their blocks, where they are the
part of the automaton that the block's texts can reach.
"""

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.llm.common import mix64, saved, sliced

#: Tokens of a block; a longer text is a block of its own.
BLOCK = 3_000_000
#: Words that a text is read one after the other.
SPAN = 1 << 12
#: Words of an arc with those of its state.
ORDER = 3
#: What the unigram counts begin with, and how often a state of one word, of two words and so on must have been seen to weigh as
#: much as the state it fails to; longer ones take the last number.
PRIOR = 0.1
MU = (400.0, 25.0)
FOLDS = 10

END_HASH = np.uint64(0x5851F42D4C957F2D)
_BASE = np.uint64(0x9E3779B97F4A7C15)

BLOCK_FIELDS = "block long, doc_ids array<long>, lengths array<long>, held array<boolean>, words binary, vocabulary binary"


def _zip(x: np.ndarray) -> bytes:
    """Integers by planes of bytes, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)
    return np.uint64(len(x)).tobytes() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unzip(data: bytes, kind) -> np.ndarray:
    n = int(np.frombuffer(data[:8], np.uint64)[0])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, n).T).reshape(-1).view(kind)


def _zip_sorted(keys: np.ndarray) -> bytes:
    return _zip(np.diff(keys, prepend=np.uint64(0)))


def _unzip_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unzip(data, np.uint64), dtype=np.uint64)


def is_held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else b"%d" % doc_id) % folds == 0


def word_blocks(docs: DataFrame, block: int = BLOCK, folds: int = FOLDS) -> DataFrame:
    """Documents as numbers of their block's sorted word hashes, each text with an end token behind it."""
    schema = docs.sparkSession.createDataFrame([], BLOCK_FIELDS).schema

    def build(batches):
        from linesieve.llm.common import arrow_schema
        uid = TaskContext.get().partitionId() << 32
        ids, hashes, total = [], [], 0
        digest = xxhash.xxh3_64_digest

        def done():
            vocabulary, numbers = np.unique(np.concatenate(hashes), return_inverse=True)
            row = [[uid], [ids], [[len(h) for h in hashes]], [[is_held_out(i, folds) for i in ids]],
                   [_zip(numbers.astype(np.uint32))], [_zip_sorted(vocabulary)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, types)], schema=types)

        types = arrow_schema(schema)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode().lower().split()
                own = np.append(np.frombuffer(b"".join([digest(w) for w in words]), np.uint64), END_HASH)
                if ids and total + len(own) > block:
                    yield done()
                    uid += 1
                    ids, hashes, total = [], [], 0
                ids.append(doc_id)
                hashes.append(own)
                total += len(own)
        if ids:
            yield done()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, schema)


class Block:
    """One block, read back: words as numbers, the number of a text's start being that of no word.

    ``codes[k]`` are the block's n-grams of k words, sorted: the number of the n-gram without its last
    word (at k = 2 a word) times ``width``, plus the last word. ``suffix[k]`` is the number of each
    without its first word, ``counts[k]`` its occurrences in the block's training texts. For states,
    ``at[k]`` is the number of the n-gram that ends at each word, -1 where a text has not said so much yet.
    """

    def __init__(self, row: dict, order: int):
        self.doc_ids, self.held, self.order = row["doc_ids"], np.array(row["held"], bool), order
        self.lengths = np.array(row["lengths"], np.int64)
        self.vocabulary = _unzip_sorted(row["vocabulary"])
        self.words = _unzip(row["words"], np.uint32).view(np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.start_state = len(self.vocabulary)
        self.width = self.start_state + 1
        trained = np.repeat(~self.held, self.lengths)
        self.counts = {1: np.bincount(self.words[trained], minlength=len(self.vocabulary))}
        self.at, self.codes, self.suffix = {1: self.words}, {}, {}
        for k in range(2, order + 1):
            before = self.at[k - 1]
            if k == 2:
                there, codes = slice(None), np.roll(before, 1).astype(np.int64)
                codes[self.starts] = self.start_state
            else:
                late = np.ones(len(self.words), bool)
                for skipped in range(k - 2):
                    late[(self.starts + skipped)[self.lengths > skipped]] = False
                there = np.flatnonzero(late)
                codes = before[there - 1].astype(np.int64)
            codes *= self.width
            codes += self.words[there]
            self.codes[k], number = np.unique(codes, return_inverse=True)
            del codes
            self.suffix[k] = np.empty(len(self.codes[k]), np.int32)
            self.suffix[k][number] = before[there]
            self.counts[k] = np.bincount(number[trained[there]], minlength=len(self.codes[k]))
            if k < order:
                self.at[k] = np.full(len(self.words), -1, np.int32)
                self.at[k][there] = number

    def sorted_keys(self):
        """(k, hashes of the n-grams of k words by number, their order as numbers of the block)."""
        keys = np.append(self.vocabulary, mix64(np.array([END_HASH]))[0])
        words = mix64(keys)
        yield 1, self.vocabulary, np.arange(len(self.vocabulary))
        for k in range(2, self.order + 1):
            keys = keys[self.codes[k] // self.width]
            keys *= _BASE
            keys += words[self.codes[k] % self.width]
            keys = mix64(keys)
            order = np.argsort(keys).astype(np.int32)
            yield k, keys, order
            del order

    def asks(self):
        """(order, sorted keys, training counts within the block)."""
        for k, keys, order in self.sorted_keys():
            yield k, keys[order], self.counts[k][order]


ASK_FIELDS = "part long, block long, n int, keys binary, counts binary"


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` ranges of the key space a key is in; sorted keys give sorted parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def questions(blocks: DataFrame, parts: int, order: int) -> DataFrame:
    """One row for each block, order and part of the key space that has keys: the block's keys there, with its counts.

    There are as many parts as blocks, so that a part's rows fit a task; there are never more rows
    than distinct n-grams of the blocks, so their number stays in proportion to the text.
    """

    def ask(batches):
        for batch in sliced(batches, 1):
            for row in batch.to_pylist():
                for k, keys, counts in Block(row, order).asks():
                    cuts = np.searchsorted(_part(keys, parts), np.arange(parts + 1))
                    for part in np.flatnonzero(np.diff(cuts)).tolist():
                        own = slice(cuts[part], cuts[part + 1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([k], pa.int32()),
                             pa.array([_zip_sorted(keys[own])], pa.binary()),
                             pa.array([_zip(counts[own].astype(np.uint32))], pa.binary())],
                            names=["part", "block", "n", "keys", "counts"])

    return blocks.mapInArrow(ask, ASK_FIELDS)


ANSWER_FIELDS = "block long, part long, n int, counts binary, types long, tokens long"


def _answer(table: pa.Table) -> pa.Table:
    """Counts over all blocks for each question of one part and order, in the question's order of keys."""
    rows = table.to_pylist()
    order = rows[0]["n"]
    keys = [_unzip_sorted(r["keys"]) for r in rows]
    counts = np.concatenate([_unzip(r["counts"], np.uint32) for r in rows])
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(known)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    out = []
    for i, (row, end) in enumerate(zip(rows, ends.tolist())):
        first = i == 0 and order == 1
        out.append((row["block"], row["part"], order, _zip(total[at[end - len(keys[i]):end]]), int((total > 0).sum()) if first else 0,
                    int(total.sum()) if first else 0))
    names = ["block", "part", "n", "counts", "types", "tokens"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


class Automaton:
    """The reachable part of the model: arcs by (state, word), failure arcs by state, the root's arcs by word.

    States are numbered by their words: first the block's words and the start of a text, then its
    n-grams of two words and so on, the root last. ``counts[k]`` are those of the whole corpus.
    """

    def __init__(self, block: Block, counts: dict, tokens: int, types: int, mu):
        order, width = block.order, block.width
        mu = [mu] if isinstance(mu, (int, float)) else list(mu)
        chance = (counts[1] + PRIOR) / (tokens + PRIOR * (types + 1))
        self.root_arcs, self.width = np.log10(chance), width
        trained_texts = counts[1][np.searchsorted(block.vocabulary, END_HASH)]
        seen = np.append(counts[1], trained_texts)  # how often a state was left in training
        sizes = [width] + [len(block.codes[k]) for k in range(2, order)] if order > 1 else []
        self.first = np.append(0, np.cumsum(sizes, dtype=np.int64)).astype(np.int64)  # of the states of one word, two and so on
        self.root = int(self.first[-1])
        self.known = np.empty(self.root, bool)
        self.fail = np.empty(self.root)
        self.down = np.full(self.root, self.root, np.int64 if self.root >> 31 else np.int32)
        self.arcs, self.weights, self.targets = [], [], []
        for k in range(2, order + 1):  # arcs of k words, from states of k - 1
            price = float(mu[min(k - 2, len(mu) - 1)])
            own = slice(self.first[k - 2], self.first[k - 1])
            self.known[own] = seen > 0
            self.fail[own] = np.log10(price / (seen + price))
            if k > 2:
                self.down[own] = block.suffix[k - 1] + self.first[k - 3]
            chance = chance[block.suffix[k]]
            chance *= price
            chance += counts[k]
            chance /= seen[block.codes[k] // width] + price
            real = np.flatnonzero(counts[k])
            self.arcs.append(block.codes[k][real])
            self.weights.append(np.log10(chance[real]))
            target = real + self.first[k - 1] if k < order else block.suffix[k][real] + self.first[k - 2]
            self.targets.append(target.astype(self.down.dtype))
            del target
            seen = counts[k]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log-probabilities) of reading one word in each state."""
        state, said = state.copy(), np.zeros(len(word))
        after = np.full(len(word), -1)
        for level in range(len(self.arcs) - 1, -1, -1):
            arcs, first = self.arcs[level], self.first[level]
            here = np.flatnonzero((after < 0) & (state >= first) & (state < self.first[level + 1]))
            key = (state[here] - first) * self.width + word[here]
            at = np.searchsorted(arcs, key)
            found = arcs[np.minimum(at, len(arcs) - 1)] == key if len(arcs) else np.zeros(len(here), bool)
            took, failed = here[found], here[~found]
            said[took] += self.weights[level][at[found]]
            after[took] = self.targets[level][at[found]]
            said[failed] += self.fail[state[failed]]
            state[failed] = self.down[state[failed]]
        rest = np.flatnonzero(after < 0)
        own = word[rest]
        said[rest] += self.root_arcs[own]
        after[rest] = np.where(self.known[own], own, self.root) if len(self.arcs) else self.root
        return after, said

    def state_after(self, block: Block, place: np.ndarray) -> np.ndarray:
        """The state in which the traversal leaves the words at ``place``: the longest that training has seen."""
        state = np.full(len(place), self.root)
        for level in range(len(self.arcs)):
            number = block.at[level + 1][place].astype(np.int64)
            there = number >= 0
            there[there] = self.known[number[there] + self.first[level]]
            state[there] = number[there] + self.first[level]
        return state


def traverse(block: Block, automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(score, root score) of every text: all texts of the block are read together, left to right, one word a step.

    A long text is read as several spans at once. The few words before a span decide the state in which
    it begins, so a step is never waited for longer than SPAN words.
    """
    counts = -(-block.lengths // SPAN)
    text = np.repeat(np.arange(len(counts)), counts)
    skipped = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * SPAN
    starts, lengths = block.starts[text] + skipped, np.minimum(block.lengths[text] - skipped, SPAN)
    longest = np.argsort(-lengths, kind="stable")
    text, skipped, starts, lengths = text[longest], skipped[longest], starts[longest], lengths[longest]
    begin = block.start_state if len(automaton.arcs) and automaton.known[block.start_state] else automaton.root
    state = np.where(skipped == 0, begin, automaton.state_after(block, np.maximum(starts - 1, 0)))
    score, base = np.zeros(len(text)), np.zeros(len(text))
    active = np.searchsorted(-lengths, -np.arange(1, lengths.max(initial=0) + 1), side="right")
    for t, m in enumerate(active.tolist()):
        word = block.words[starts[:m] + t]
        state[:m], said = automaton.step(state[:m], word)
        score[:m] += said
        base[:m] += automaton.root_arcs[word]
    n = len(block.lengths)
    return np.bincount(text, score, n), np.bincount(text, base, n)


SCORE_FIELDS = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double")


def _score_block(blocks: pa.Table, answers: pa.Table, tokens: int, types: int, order: int, mu) -> pa.Table:
    block = Block(blocks.to_pylist()[0], order)
    block.counts = None  # those of the whole corpus take their place
    found, at = {}, answers.column("counts")
    rows = sorted(zip(answers.column("n").to_pylist(), answers.column("part").to_pylist(), range(len(at))))
    for k, _, places in block.sorted_keys():
        found[k], done = np.empty(len(places), np.int64), 0
        for _, _, i in (r for r in rows if r[0] == k):  # one answer after the other, not all of them beside their places
            own = _unzip(at[i].as_py(), np.int64)
            found[k][places[done:done + len(own)]] = own
            done += len(own)
        if done != len(places):
            raise ValueError(f"{done} answers for {len(places)} n-grams of {k} words")
    automaton = Automaton(block, found, tokens, types, mu)
    block.codes = block.suffix = None
    known = np.add.reduceat((found.pop(1) > 0)[block.words], block.starts, dtype=np.int64)
    del found, places
    score, base = traverse(block, automaton)
    n = len(score)
    return pa.table([pa.array(block.doc_ids, pa.int64()), pa.array(block.held), pa.array(block.lengths), pa.array(known),
                     pa.array(np.full(n, tokens, np.int64)), pa.array(base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, order: int = ORDER, mu=MU, block: int = BLOCK, folds: int = FOLDS) -> DataFrame:
    """Log10 probabilities of every whole text under the model of the texts that are not held out.

    Tokens are words, A-Z lowered, and one end. Columns doc_id, held_out, n_tokens, n_known (tokens
    seen in training), train_tokens, base_score (the root alone) and score (the automaton of n-grams
    of up to ``order`` words; ``mu`` is one number or one for each length of state). A null
    or empty text is its end alone. Rows stay, repeated ones too, and count each; a null id is held
    out. Without any training text every word has the same chance. Empty table: empty result; other
    columns take no part. N-grams are told apart by 64 bits of hash.
    """
    blocks = saved(word_blocks(docs, block, folds))
    parts = max(1, blocks.count())
    answers = saved(questions(blocks, parts, order).groupBy("part", "n").applyInArrow(_answer, ANSWER_FIELDS))
    tokens, types = answers.agg(F.sum("tokens"), F.sum("types")).first()
    scored = partial(_score_block, tokens=tokens or 0, types=types or 0, order=order, mu=mu)
    return (blocks.groupBy("block").cogroup(answers.select("block", "part", "n", "counts").groupBy("block"))
            .applyInArrow(scored, SCORE_FIELDS))
