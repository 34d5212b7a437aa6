import random
import re
from collections import Counter

import pytest

from linesieve.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)

    def under(n):
        grams = Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
        return {j for i in range(len(words) - n + 1) if grams[tuple(words[i:i + n])] > 1 for j in range(i, i + n)}

    chars = sum(map(len, words))
    shares = [sum(len(words[j]) for j in under(n)) / chars if chars else 0 for n in quality.MAX_GRAM_SHARE]
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, len(under(3)), *shares


def texts():
    rng = random.Random(5)
    signs = ["a", "b", "é", "漢x", "c#", "\n", "\t", " ", "  ", "\x0b", "\x1c", "\xa0", "%&"]
    out = ["", " \n ", "a b c a b c", "x\n\nx\n\n x\nx", "a b c d e f g " * 20]
    for _ in range(400):
        words = [rng.choice(signs) + rng.choice(signs) for _ in range(rng.randint(0, 80))]
        out.append(rng.choice([" ", "\n"]).join(words) + (" ".join(words[:15]) if rng.random() < 0.5 else ""))
    return out


@pytest.mark.parametrize("id_bits", [21, 1])
def test_measures(monkeypatch, id_bits):
    monkeypatch.setattr(quality, "_ID_BITS", id_bits)
    if id_bits == 1:  # the way for texts of more different words than fit the packed key
        monkeypatch.setattr(quality, "exact_triples", quality.exact_triples)
    for text in texts():
        assert quality.measure(text)[:-1] == pytest.approx(brute(text)), repr(text)


def test_verdicts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    clean = " ".join(word() for _ in range(200))
    passage = " ".join(word() for _ in range(40))
    cases = [(None, True, False), ("", True, False), ("short text", True, False), (clean, False, True),
             ("spam spam spam " * 40, True, False), (f"{clean} {passage}\n{passage} {clean[:60]}\n{passage}", False, False),
             ("\n".join([clean[:300], *["again and again"] * 2, clean[300:]]), False, True)]
    df = spark.createDataFrame([(i, t, True, "x") for i, (t, _, _) in enumerate(cases)], "doc_id long, text string, kept boolean, source string")
    out = {r.doc_id: r for r in quality.judge(df, "text", ["doc_id", "kept", "source"]).collect()}
    assert [(out[i].base_failed, out[i].kept) for i in range(len(cases))] == [c[1:] for c in cases]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, c in enumerate(cases) if c[2]]
    assert quality.keep_good(df.limit(0)).collect() == quality.judge(df.limit(0)).collect() == []
