"""Boundaries of the public byte-level pre-tokenisation, found without a regular expression.

The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+.
Every code point gets a class; with its right neighbours a class is a function from the state
before the character to the state after it. Composition of such functions is associative and
their closure is small, so prefixes of whole blocks are composed by table look-up, column by
column over many blocks at once; the blocks' totals are scanned the same way.
"""

from functools import cache

import numpy as np
import pyarrow as pa

# States: what the running token is, or that the next character starts one.
START, LETTERS, NUMBERS, OTHERS, PREFIX, SPACES, ONE_MORE, TWO_MORE = range(8)
# Classes; RESET stands between texts. The last two open a contraction of two or three characters.
RESET, LETTER, NUMBER, OTHER, SPACE_IN, SPACE_PREFIX, SPACE_LAST, QUOTE_1, QUOTE_2 = range(9)

#: Libraries whose reading of \\p{L}, \\p{N} and \\s the boundaries can follow; their tables are of different Unicode editions.
TIKTOKEN, TOKENIZERS = "tiktoken", "tokenizers"

BLOCK = 64
#: Characters that are scanned at once; a longer text goes through in pieces cut at token boundaries.
CHUNK = 1 << 20
LOOK_AHEAD = 4


def _next_state(cls: int, state: int) -> int:
    if cls == LETTER:
        return {ONE_MORE: START, TWO_MORE: ONE_MORE}.get(state, LETTERS)
    if cls in (QUOTE_1, QUOTE_2):
        return OTHERS if state in (PREFIX, OTHERS) else ONE_MORE if cls == QUOTE_1 else TWO_MORE
    return {RESET: START, NUMBER: NUMBERS, OTHER: OTHERS, SPACE_IN: SPACES, SPACE_PREFIX: PREFIX, SPACE_LAST: START}[cls]


_JOINS = {LETTER: {LETTERS, PREFIX, ONE_MORE, TWO_MORE}, NUMBER: {NUMBERS, PREFIX}, OTHER: {OTHERS, PREFIX},
          QUOTE_1: {OTHERS, PREFIX}, QUOTE_2: {OTHERS, PREFIX}, SPACE_IN: {SPACES}}


def _matched(pattern: str, library: str) -> list[int]:
    """All code points that a pattern for one character meets, asked of the library itself."""
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    if library == TIKTOKEN:  # what the pattern does not meet has no tokens
        import tiktoken
        single_bytes = {bytes([b]): b for b in range(256)}
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single_bytes, special_tokens={})
        return [ord(c) for c in bytes(probe.encode_ordinary(text)).decode()]
    from tokenizers import Regex
    from tokenizers.normalizers import Replace
    return [ord(c) for c in Replace(Regex(f"[^{pattern}]+"), "").normalize_str(text)]


@cache
def classes(library: str = TIKTOKEN) -> np.ndarray:
    """The class of each code point, as the library reads it."""
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, cls in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE_IN)):
        out[_matched(pattern, library)] = cls
    return out


@cache
def tables():
    """Composition table; state after a function; function of a class; whether a class opens a token."""
    base = [tuple(_next_state(c, s) for s in range(8)) for c in range(9)]
    functions = list(dict.fromkeys(base))
    seen = set(functions)
    for f in functions:  # grows while it is read: the closure under composition
        for g in base:
            if (h := tuple(g[f[s]] for s in range(8))) not in seen:
                seen.add(h)
                functions.append(h)
    index = {f: i for i, f in enumerate(functions)}
    n = len(functions)
    compose = np.zeros((n, n), np.uint8)
    for i, f in enumerate(functions):
        for j, g in enumerate(functions):
            h = tuple(g[f[s]] for s in range(8))
            compose[i, j] = index[h]
    apply = np.array(functions, np.uint8)
    of_class = np.array([index[f] for f in base], np.uint8)
    opens = np.array([[s not in _JOINS.get(c, ()) for s in range(8)] for c in range(9)])
    return compose, apply, of_class, opens


def _states(functions: np.ndarray, state: int) -> np.ndarray:
    """The state after each of the ``functions``, beginning in ``state``: a blocked associative scan."""
    compose, apply, _, _ = tables()
    n, width = len(functions), len(compose)
    if n <= BLOCK:
        out = np.empty(n, np.uint8)
        for i, f in enumerate(functions.tolist()):
            out[i] = state = int(apply[f, state])
        return out
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, np.uint8)
    padded[:n] = functions
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    flat = compose.reshape(-1)
    for j in range(1, BLOCK):
        columns[j] = flat[columns[j - 1].astype(np.uint16) * np.uint16(width) + columns[j]]
    begins = np.empty(rows, np.uint8)
    begins[0] = state
    begins[1:] = _states(columns[-1], state)[:-1]
    after = apply.reshape(-1)[columns.astype(np.uint16) * np.uint16(8) + begins]
    return np.ascontiguousarray(after.T).reshape(-1)[:n]


def _codes(chars: str) -> list[int]:
    return [ord(c) for c in chars]


def _classes(points: np.ndarray, breaks: np.ndarray, library: str) -> np.ndarray:
    cls = classes(library)[points]
    cls[breaks] = RESET
    space = cls == SPACE_IN
    last = np.zeros(len(cls), bool)
    last[:-1] = space[:-1] & ~space[1:] & (cls[1:] != RESET)
    cls[last] = np.where(points[last] == 32, SPACE_PREFIX, SPACE_LAST)
    quote = np.flatnonzero((points == 39) & (cls != RESET))
    if len(quote):
        real = np.append(np.where(cls == RESET, 0, points), [0, 0])
        one, two = real[quote + 1], real[quote + 2]
        cls[quote[np.isin(one, _codes("stmd"))]] = QUOTE_1
        cls[quote[((two == ord("e")) & np.isin(one, _codes("rv"))) | ((one == ord("l")) & (two == ord("l")))]] = QUOTE_2
    return cls


def boundaries(text: str, breaks: np.ndarray, library: str = TIKTOKEN) -> np.ndarray:
    """Positions in ``text`` where a token starts. ``breaks`` are positions of characters that separate texts."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64)
    _, _, of_class, opens = tables()
    cls = _classes(points, breaks, library)
    after = _states(of_class[cls], START)
    before = np.empty_like(after)
    before[0] = START
    before[1:] = after[:-1]
    begin = opens[cls, before]
    begin[breaks] = False
    return np.flatnonzero(begin)


def pieces(texts: list[str], library: str = TIKTOKEN):
    """Yields (index of the text, its next slices), in order; a long text comes in several parts."""
    for spans, slices in cuts(texts, library):
        own, at = slices.to_numpy(zero_copy_only=False).tolist(), 0
        for i, n in spans:
            yield i, own[at:at + n]
            at += n


def cuts(texts: list[str], library: str = TIKTOKEN):
    """``pieces`` of many texts at once: (list of (text, number of its next slices), an Arrow array of all of these)."""
    group, first, size = [], 0, 0
    for i, text in enumerate(texts):
        if len(text) > CHUNK:
            yield from _group(group, first, library)
            yield from (([(i, len(part))], part) for part in _long(text, library))
            group, first, size = [], i + 1, 0
            continue
        if size + len(text) > CHUNK and group:
            yield from _group(group, first, library)
            group, first, size = [], i, 0
        group.append(text)
        size += len(text) + 1
    yield from _group(group, first, library)


def _slices(text: str, bounds: np.ndarray) -> pa.LargeStringArray:
    """The parts of ``text`` between each two neighbours of ``bounds``; its bytes are not copied again."""
    data = text.encode()
    if len(data) > len(text):
        characters = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        bounds = np.append(characters, len(data))[bounds]
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data))


def _group(texts: list[str], first: int, library: str):
    if not texts:
        return
    joined = "\n".join(texts) + "\n"
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    starts = boundaries(joined, ends, library)
    upto = np.searchsorted(starts, ends)
    slices = _slices(joined, np.append(np.insert(starts, upto, ends), len(joined)))
    real = np.ones(len(slices), bool)
    real[upto + np.arange(len(ends))] = False  # what separates the texts
    yield list(zip(range(first, first + len(texts)), np.diff(upto, prepend=0).tolist())), slices.filter(pa.array(real))


def _long(text: str, library: str):
    none = np.zeros(0, np.int64)
    begin, width = 0, CHUNK
    while begin < len(text):
        end = min(len(text), begin + width)
        part = text[begin:end]
        bounds = boundaries(part, none, library)
        if end < len(text):  # what starts near the cut may change with the characters behind it
            bounds = bounds[bounds <= len(part) - LOOK_AHEAD]
            if len(bounds) < 2:
                width *= 2
                continue
        else:
            bounds = np.append(bounds, len(part))
        yield _slices(part, bounds)
        begin, width = begin + int(bounds[-1]), CHUNK
