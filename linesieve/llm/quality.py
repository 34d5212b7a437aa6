"""Repetition rules: how much of a text stands in lines and word n-grams that occur more than once.

Words become numbers of the text's own word list; n-grams of several lengths become rolling
hashes over those numbers, all in numpy. Characters under at least one repeated n-gram count once.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linesieve.llm.common import _BREAK_TABLE, fresh, map_texts, mix64, sliced

MIN_WORDS = 50
#: Percent of the words that may stand in repeated windows of three words.
MAX_REPEATED_WORDS = 50
#: Characters of a text that mark symbols.
SYMBOLS = b"#*$%&|<>"
#: Greatest share of a text's word characters in repeated n-grams, by n, and in repeated lines.
MAX_GRAM_SHARE = {5: 0.30, 7: 0.26, 10: 0.20}
MAX_LINE_SHARE = 0.30

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL_TABLE = np.zeros(256, bool)
_SYMBOL_TABLE[list(SYMBOLS)] = True
_ID_BITS = 21


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the ``keys`` occur more than once."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    return np.isin(keys, twice) if len(twice) else np.zeros(len(keys), bool)


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words under at least one n-gram whose start is marked."""
    out = np.zeros(words, bool)
    if starts.any():
        for k in range(n):
            out[k:k + len(starts)] |= starts
    return out


def word_numbers(words: list[bytes]) -> tuple[np.ndarray, int]:
    known: dict[bytes, int] = {}
    numbers = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    return numbers, len(known)


def exact_triples(numbers: np.ndarray, known: int) -> np.ndarray:
    """One key for each window of three words, equal only for equal words."""
    a, b, c = numbers[:-2], numbers[1:-1], numbers[2:]
    if known < 1 << _ID_BITS:
        return a << 2 * _ID_BITS | b << _ID_BITS | c
    pairs = np.unique(numbers[:-1] * known + numbers[1:], return_inverse=True)[1]
    return pairs[:-1] * known + c


def measure(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, shares by n-gram length, share of lines."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    words = data.split()
    n = len(words)
    n_symbols = int(_SYMBOL_TABLE[raw].sum())
    begins = (raw & 0xC0) != 0x80
    word_chars = int((begins & ~_BREAK_TABLE[raw]).sum())
    seen, n_dup_lines, dup_line_chars = set(), 0, 0
    for line in data.split(b"\n"):
        if line in seen:
            n_dup_lines += 1
            dup_line_chars += sum(len(w.decode()) for w in line.split())
        elif line and not line.isspace():
            seen.add(line)
    shares = dict.fromkeys(MAX_GRAM_SHARE, 0.0)
    n_repeat = 0
    if n >= 3:
        numbers, known = word_numbers(words)
        n_repeat = int(covered(repeated(exact_triples(numbers, known)), 3, n).sum())
        if n_repeat:  # a longer n-gram can only repeat where its triples do
            sizes = np.array([len(w) if w.isascii() else len(w.decode()) for w in words], np.int64)
            single = mix64(numbers + 1)
            gram = single
            for k in range(2, max(MAX_GRAM_SHARE) + 1):
                if k > n:
                    break
                gram = gram[:-1] * _BASE + single[k - 1:]
                if k in MAX_GRAM_SHARE:
                    shares[k] = float(sizes[covered(repeated(gram), k, n)].sum()) / word_chars
    return (n, word_chars, n_symbols, n_dup_lines, n_repeat, *shares.values(),
            dup_line_chars / word_chars if word_chars else 0.0)


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, verdict_only: bool = False) -> DataFrame:
    """Measures and verdict of every text; ``keep`` names columns that go along.

    ``base_failed``: under MIN_WORDS words, or too many words in repeated windows of three.
    ``kept``: not failed, and no share of word characters in repeated n-grams or lines is over its limit.
    Shares are ``share_5``, ``share_7``, ``share_10`` and ``share_lines``. A null or empty text
    has no words and fails. Whole texts count, however long. Rows stay as they are, repeated ones
    too; a kept column named like a result gives way.
    """
    grams = list(MAX_GRAM_SHARE)

    def kernel(texts):
        rows = [measure(t) for t in texts]
        columns = [np.array(c) for c in zip(*rows)] if rows else [np.zeros(0)] * (6 + len(grams))
        n, _, _, _, repeat, *shares = columns
        failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEATED_WORDS * n)
        kept = ~failed
        for share, limit in zip(shares, [*MAX_GRAM_SHARE.values(), MAX_LINE_SHARE]):
            kept = kept & (share <= limit)
        if verdict_only:
            return [pa.array(kept, pa.bool_())]
        return [*[pa.array(c, pa.int64()) for c in columns[:5]], *[pa.array(c, pa.float64()) for c in shares],
                pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())]

    if verdict_only:
        return map_texts(docs, kernel, "kept boolean", text, keep)
    return map_texts(docs, kernel, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                     + ", ".join(f"share_{k} double" for k in grams)
                     + ", share_lines double, base_failed boolean, kept boolean", text, keep)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is kept; see ``judge``."""
    columns = docs.columns
    source = docs.select(*[f"`{c}`" for c in columns], docs[text].alias(fresh(docs, "judged")))

    def kept(batches):
        for batch in sliced(batches):
            texts = ["" if t is None else t for t in batch.column(len(columns)).to_pylist()]
            good = pa.array([passes(measure(t)) for t in texts], pa.bool_())
            yield batch.select(list(range(len(columns)))).filter(good)

    return source.mapInArrow(kept, docs.schema)


def passes(row: tuple) -> bool:
    """The verdict of ``judge`` for one measured text."""
    n, _, _, _, repeat, *shares = row
    limits = [*MAX_GRAM_SHARE.values(), MAX_LINE_SHARE]
    return n >= MIN_WORDS and 100 * repeat <= MAX_REPEATED_WORDS * n and all(s <= m for s, m in zip(shares, limits))
