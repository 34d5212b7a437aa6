import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import AddedToken, Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from linesieve.llm import bpe, packing, pretoken

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return own


def first_fit_decreasing(lengths, size):
    room, place = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(size)
        place[i] = (b, size - room[b])
        room[b] -= lengths[i]
    return [place[i] for i in range(len(lengths))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 200])
def test_tournament_is_first_fit_decreasing(n):
    rng = random.Random(n)
    lengths = [rng.randint(1, 50) for _ in range(n)]
    bins, offsets = packing.tournament_pack(np.array(lengths, np.int64), 50)
    assert list(zip(bins.tolist(), offsets.tolist())) == first_fit_decreasing(lengths, 50)


def test_ids_are_the_librarys(library, monkeypatch):
    rng = random.Random(3)
    signs = list("abst relvdm''' \n\t  1½é漢　-.,!\x85\x1c͸Ᲊ") + ["'re", "<|endoftext|>", "the "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in packing.token_ids(texts, PATH)] == want
    monkeypatch.setattr(pretoken, "CHUNK", 9)  # texts are cut far more often
    assert [ids.tolist() for ids in packing.token_ids(texts, PATH)] == want


def test_every_id_has_one_place(spark, library):
    rng = random.Random(4)
    words = "the of and thing theory word list number".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 300, 5000]))) for _ in range(150)] + [None, "", "same", "same"]
    rows = [(None if i == 3 else i, t, 9, 8) for i, t in enumerate(texts)] + [(0, texts[0], 9, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid int, length int")
    out = packing.pack(df, PATH, group=32).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t, _, _ in rows[:-1]:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[i]})
        assert sum(p[1] for p in pieces) == len(ids) and [p[0] for p in pieces] == np.cumsum([0, *[p[1] for p in pieces]])[:-1].tolist()
        for start, length, crc, total in pieces:
            assert crc == zlib.crc32(ids[start:start + length].tobytes()) and total == len(ids)
    assert len(by_doc[0]) == 2 * len({r.start for r in by_doc[0]})
    used = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        used += at
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_added_tokens_are_the_librarys(spark, monkeypatch):
    own = Tokenizer.from_file(PATH)  # no setting changed
    rng = random.Random(5)
    signs = list("abst relvdm''' \n\t  1½é漢　-.,!\x85\x1c͸Ᲊ<|>") + ["'re", "<|endoftext|>", "<|endoftext", "the "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", "<|endoftext|>", "<|endoftext|>" * 3]
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(50256 in ids for ids in want) > 100
    assert [ids.tolist() for ids in packing.document_ids(texts, PATH)] == want
    monkeypatch.setattr(pretoken, "CHUNK", 9)  # texts are cut far more often
    assert [ids.tolist() for ids in packing.document_ids(texts, PATH)] == want
    row = packing.cut_documents(spark.createDataFrame([(1, "a b <|endoftext|> c")], "doc_id long, text string"), PATH).first()
    ids = np.array([64, 275, 220, 50256, 269, 1], "<u4")
    assert (row.length, row.doc_tokens, row.ids_crc32) == (6, 6, zlib.crc32(ids.tobytes()))


def test_added_tokens_with_marks(tmp_path):
    own = Tokenizer.from_file(PATH)
    own.add_special_tokens([AddedToken("<pad>", lstrip=True, single_word=True)])
    path = str(tmp_path / "own.json")
    own.save(path)
    texts = ["a <pad> b", "a<pad>b", "x  <pad>", "<|endoftext|> <pad>", ""]
    assert [ids.tolist() for ids in packing.document_ids(texts, path)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_code_point_is_read_as_by_the_library():
    from test_bpe import every_code_point
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = every_code_point(lambda c: f"a{c}7")
    assert [x.tolist() for x in packing.token_ids(texts, path)] == [
        e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_a_slice_is_looked_up_once_for_many_texts(library):
    class Counted(bpe.Pieces):
        asked = 0

        def __getitem__(self, piece):
            self.asked += 1
            return super().__getitem__(piece)

    pieces = Counted(lambda new: [e.ids for e in library.encode_batch_fast(new, add_special_tokens=False)])
    texts = ["the list é of words " * 500, "", "the list"] * 20
    got = [[] for _ in texts]
    for i, ids in bpe.encoded(texts, pieces, pretoken.TOKENIZERS):
        got[i] += ids.tolist()
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert pieces.asked < 20


def test_the_model_alone_gives_the_librarys_ids(library, tmp_path, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abst relé漢\n'7\x00\xa0ÿ😀") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    slices = list(dict.fromkeys(s for _, own in pretoken.pieces([*words, "aé" * 5000], pretoken.TOKENIZERS) for s in own))
    monkeypatch.setattr(packing, "MODEL_SLICES", 100)
    assert packing._model_ids(library)(slices) == [e.ids for e in library.encode_batch(slices, add_special_tokens=False)]
    assert packing._model_ids(library)([]) == []
    other = Tokenizer.from_file(PATH)
    other.pre_tokenizer = ByteLevel(add_prefix_space=True)
    assert packing._model_ids(other) is None
