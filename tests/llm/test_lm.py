import math
import random
import re
import zlib
from collections import Counter

import pytest

from linesieve.llm import lm


def brute(rows, mu, order):
    """The model by dictionaries over all training texts."""
    tokens = {i: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                  for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for i, (_, t) in enumerate(rows)}
    held = {i: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for i, (d, _) in enumerate(rows)}
    words, grams, states = Counter(), Counter(), Counter()
    for i, own in tokens.items():
        if not held[i]:
            words.update(own)
            said = ("<s>!", *own)
            for k in range(2, order + 1):
                for t in range(k - 1, len(said)):
                    grams[said[t - k + 1:t + 1]] += 1
                    states[said[t - k + 1:t]] += 1
    total, kinds = sum(words.values()), len(words)

    def chance(context, w):
        if not context:
            return (words[w] + 0.1) / (total + 0.1 * (kinds + 1))
        return (grams[(*context, w)] + mu[len(context) - 1] * chance(context[1:], w)) / (states[context] + mu[len(context) - 1])

    out = []
    for i, (d, _) in enumerate(rows):
        own = tokens[i]
        said = ("<s>!", *own)
        base = sum(math.log10(chance((), w)) for w in own)
        full = sum(math.log10(chance(said[max(0, t - order + 1):t] if order > 1 else (), said[t])) for t in range(1, len(said)))
        out.append((d, held[i], len(own), sum(words[w] > 0 for w in own), total, round(base, 6), round(full, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,order", [(30, 2), (1_000_000, 2), (30, 3), (1_000_000, 3), (200, 4), (200, 1)])
def test_scores_are_the_models(spark, block, order):
    rng = random.Random(7)
    words = ["the", "The", "of", "a", "é", "É", "Äpfel", "x.", "zz", "rare"] + [f"w{i}" for i in range(30)]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    rows += [(5, rows[5][1]), (7, "other text"), (None, "the of"), (200, None), (201, ""), (202, "unseen" * 3)]
    rows += [(300 + i, "the of a zz rare " * (i + 1)) for i in range(12)]
    df = spark.createDataFrame([(*r, 1.0, 3) for r in rows], "doc_id long, text string, score double, block int").repartition(3)
    mu = (7.0, 3.0, 0.5)
    got = [tuple(r[:5]) + (round(r.base_score, 6), round(r.score, 6)) for r in lm.score(df, order, mu, block).collect()]
    assert sorted(got, key=str) == brute(rows, mu, order)


def one_block(texts, held, order):
    hashes = [lm.np.append(lm.np.frombuffer(b"".join(lm.xxhash.xxh3_64_digest(w) for w in own), lm.np.uint64), lm.END_HASH) for own in texts]
    vocabulary, numbers = lm.np.unique(lm.np.concatenate(hashes), return_inverse=True)
    return lm.Block({"doc_ids": list(range(len(texts))), "held": held, "lengths": [len(h) for h in hashes],
                     "words": lm._zip(numbers.astype(lm.np.uint32)), "vocabulary": lm._zip_sorted(vocabulary)}, order)


def whole_automaton(block, mu):
    return lm.Automaton(block, block.counts, int(block.counts[1].sum()), int((block.counts[1] > 0).sum()), mu)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_arcs_of_a_state_and_its_failure_sum_to_one(order):
    block = one_block(["abacab", "ba", "abab", "cab"], [False] * 4, order)
    automaton = whole_automaton(block, (5.0, 2.0))
    unseen = 0.1 / (int(block.counts[1].sum()) + 0.1 * (len(block.vocabulary) + 1))
    assert sum(10.0 ** automaton.root_arcs) + unseen == pytest.approx(1)
    end = int(lm.np.searchsorted(block.vocabulary, lm.END_HASH))
    inner = {int(s) for s in set(range(automaton.root)) if s != end}
    for k in range(2, order):  # nothing follows an end
        inner -= {int(automaton.first[k - 1]) + i for i in lm.np.flatnonzero(block.codes[k] % block.width == end).tolist()}
    for state in {automaton.root} | inner:
        total, down = unseen, state
        while down != automaton.root:
            total *= 10.0 ** automaton.fail[down]
            down = int(automaton.down[down])
        for word in range(len(block.vocabulary)):
            total += 10.0 ** automaton.step(lm.np.array([state]), lm.np.array([word]))[1][0]
        assert total == pytest.approx(1)


def test_longer_states_foretell_held_out_texts_better():
    """Texts of a made-up language in which two words leave three for the next."""
    rng = random.Random(9)
    names = [f"w{i}" for i in range(60)]
    follow = {(a, b): rng.sample(names, 3) for a in names for b in names}
    texts = []
    for _ in range(1500):
        own = [rng.choice(names), rng.choice(names)]
        while len(own) < 60:
            own.append(rng.choice(follow[own[-2], own[-1]]))
        texts.append(own)
    held = [i % 10 == 0 for i in range(len(texts))]
    means = []
    for order in (1, 2, 3):
        block = one_block(texts, held, order)
        score, _ = lm.traverse(block, whole_automaton(block, (20.0, 2.0)))
        means.append(score[lm.np.array(held)].mean())
    assert means[2] > means[1] + 20 and means[1] > means[0]


def test_no_training_text_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    row = lm.score(df).collect()[0]
    assert row.held_out and row.n_known == 0 and row.train_tokens == 0 and row.score == pytest.approx(row.base_score)
    assert lm.score(df.limit(0)).collect() == []


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("span", [1, 3, 4096])
def test_spans_of_a_text_are_read_as_one(span, order, monkeypatch):
    """The spans' states are those that the whole text's traversal carries."""
    rng = random.Random(8)
    texts = [[rng.choice("abcdeF") for _ in range(rng.randint(0, 40))] for _ in range(30)] + [["z"] * 20]
    block = one_block(texts, [i % 4 == 0 for i in range(30)] + [True], order)
    automaton = whole_automaton(block, (5.0, 1.0))
    begin = block.start_state if order > 1 else automaton.root
    want = []
    for start, n in zip(block.starts, block.lengths):
        state, total, base = lm.np.array([begin]), 0.0, 0.0
        for t in range(n):
            word = block.words[start + t:start + t + 1]
            state, said = automaton.step(state, word)
            total, base = total + said[0], base + automaton.root_arcs[word][0]
        want.append((total, base))
    monkeypatch.setattr(lm, "SPAN", span)
    got = list(zip(*lm.traverse(block, automaton)))
    assert [tuple(map(float, g)) for g in got] == [pytest.approx(w) for w in want]
