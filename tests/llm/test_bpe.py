import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from linesieve.llm import bpe, pretoken

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SIGNS = list("abst relvdm''' \n\t  1½é漢　-.,!\x85\x1c") + ["'re", "'s", "'ll ", " '", "the ", "\U0001F600"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [9, 33, 1 << 20])
def test_boundaries_are_the_patterns(monkeypatch, chunk):
    monkeypatch.setattr(pretoken, "CHUNK", chunk)
    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = random_texts(3000)
    found = [[] for _ in texts]
    for i, part in pretoken.pieces(texts):
        found[i] += part
    assert found == [pattern.findall(t) for t in texts]


def test_ids_are_the_librarys(spark, library):
    rng = random.Random(2)
    texts = random_texts(300) + ["", None, "a" * 3000, "ab" * 2000 + " 漢字" * 300, " " * 3000]
    texts += ["".join(rng.choice("theranoi") for _ in range(rng.randint(60, 300))) for _ in range(50)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    rows = bpe.encode(df, PATH, "text", ["doc_id", "text", "ids"])
    for r in rows.collect():
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id] or "")
        data = (texts[r.doc_id] or "").encode()
        assert [data[a:b] for a, b in zip(r.offsets, [*r.offsets[1:], len(data)])] == [library.decode_single_token_bytes(i) for i in r.ids]
    for r in bpe.decode(rows, PATH, "ids", ["doc_id"]).collect():
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    for r in bpe.round_trip_digests(df, PATH, "text", ["doc_id", "n_tokens"]).collect():
        ids, data = library.encode_ordinary(texts[r.doc_id] or ""), (texts[r.doc_id] or "").encode()
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(data).hexdigest()
    assert bpe.round_trip_digests(df.limit(0), PATH).collect() == []


def test_forgotten_pieces_are_merged_again(monkeypatch, library):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 5)
    encoder = bpe.Pieces(lambda new: bpe.merge_all([s.encode() for s in new], PATH))
    for text in random_texts(50, 3):
        ids = [x for _, part in bpe.encoded([text], encoder) for x in part.tolist()] if text else []
        assert ids == library.encode_ordinary(text)


def every_code_point(form=lambda c: f"a{c}7 {c}'{c} "):
    """Each character beside letters, numbers, blanks and quotes, many to a text; surrogates are no text."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    return ["".join(form(chr(c)) for c in points[at:at + 2000]) for at in range(0, len(points), 2000)]


def test_every_code_point_is_read_as_by_the_library(library):
    texts = every_code_point()
    encoder = bpe.Pieces(lambda new: bpe.merge_all([s.encode() for s in new], PATH))
    found = [[] for _ in texts]
    for i, part in bpe.encoded(texts, encoder):
        found[i] += part.tolist()
    assert found == [library.encode_ordinary(t) for t in texts]
