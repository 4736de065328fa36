import io
import random

import numpy as np
import pytest

from tests.llm.conftest import DOCUMENTS, document
from tidemark.llm import toxicity
from tidemark.llm.queries import op8_toxicity

PLAIN = [f"w{c}{d}o" for c in "abcdefgh" for d in "klmnprst"]
BAD = ["scoundrel", "wretch", "blightok", "blightam", "blightus"]


def made_up(count, seed):
    """Texts with a label: the toxic ones hold a few bad words among the plain ones."""
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(count):
        words = [rng.choice(PLAIN) for _ in range(rng.randrange(5, 120))]
        labels.append(int(i % 4 == 0))
        for _ in range(labels[-1] * rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(BAD))
        texts.append(" ".join(words))
    return texts, np.array(labels)


def test_gradients_against_differences():
    texts, _ = made_up(3, 1)
    words = toxicity.Words([*texts, "a", ""])
    numbers = np.arange(len(words.hashes)) % 7
    weights = {k: v.astype(float) for k, v in toxicity.new_weights(6).items()}
    places, held, _ = words.windows()
    labels = np.arange(len(places)) % 2.0
    _, found = toxicity.gradients(words, numbers, places, held, labels, weights)
    rng = np.random.default_rng(2)
    for name, values in weights.items():
        flat, slope = values.reshape(-1), found[name].reshape(-1)
        candidates = np.flatnonzero(slope)
        for at in rng.choice(candidates, min(4, len(candidates)), replace=False):
            kept, step = flat[at], 1e-4
            losses = []
            for side in (step, -step):
                flat[at] = kept + side
                losses.append(toxicity.gradients(words, numbers, places, held, labels, weights)[0])
            flat[at] = kept
            assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(slope[at], abs=1e-6), name


def test_windows_overlap_and_hold_every_word():
    for size in (0, 1, 23, 24, 25, 40, 41, 100):
        words = toxicity.Words(["x " * size, "y"])
        places, held, firsts = words.windows()
        mine = places[: firsts[1]]
        assert set(mine[mine < size]) == set(range(size))
        starts = mine[:, 0]
        assert all(b - a == toxicity.STEP < toxicity.WINDOW for a, b in zip(starts, starts[1:]))
        assert held[: firsts[1]].max(initial=0) <= toxicity.WINDOW


def test_scores_do_not_depend_on_neighbours():
    texts, labels = made_up(80, 5)
    import io

    weights = dict(np.load(io.BytesIO(toxicity.train(texts, labels, 0.25, epochs=2))))
    vocabulary = toxicity.Vocabulary(weights.pop("vocabulary"))
    together = toxicity.score([*texts, ""], vocabulary, weights)
    alone = [toxicity.score([t], vocabulary, weights)[0] for t in [*texts, ""]]
    assert np.allclose(together, alone, atol=1e-4)


def test_held_out_accuracy(spark):
    texts, labels = made_up(900, 3)
    docs = spark.createDataFrame([document(i, t) for i, t in enumerate(texts)], DOCUMENTS)
    marks = spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    rows = [r for r in toxicity.toxicity(docs, marks).collect() if r.held_out]
    right = [r.predicted == labels[r.doc_id] for r in rows]
    assert len(rows) > 200 and np.mean(right) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_query(spark, folder, documents):
    rows = op8_toxicity(spark, folder).collect()
    assert len(rows) == documents.count()
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows(awkward, nothing, labels):
    rows = toxicity.toxicity(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(r.score == r.score for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    # One label only, or none: nothing can be learned.
    assert {r.score for r in toxicity.toxicity(awkward, labels.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(nothing, labels).collect() == []


def plain_logit(vectors, weights):
    """A window's logit, one word at a time."""
    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    size, ways = toxicity.STATE, []
    for way in "fb":
        h, states = np.zeros(size), {}
        order = range(len(vectors)) if way == "f" else reversed(range(len(vectors)))
        for t in order:
            a = vectors[t] @ weights[f"in_{way}"] + weights[f"in0_{way}"]
            gates = sigmoid(a[: 2 * size] + h @ weights[f"gates_{way}"])
            z, r = gates[:size], gates[size:]
            n = np.tanh(a[2 * size :] + r * (h @ weights[f"new_{way}"]))
            h = states[t] = (1 - z) * n + z * h
        ways.append(states)
    states = np.array([np.concatenate([ways[0][t], ways[1][t]]) for t in range(len(vectors))] or [np.zeros(2 * size)])
    marks = np.tanh(states @ weights["look"]) @ weights["ask"]
    share = np.exp(marks - marks.max())
    return (share / share.sum()) @ states @ weights["out"] + float(np.ravel(weights["out0"])[0])


def test_scores_against_a_plain_network():
    texts, labels = made_up(60, 5)
    model = dict(np.load(io.BytesIO(toxicity.train(texts, labels, 0.25, epochs=1))))
    vocabulary = toxicity.Vocabulary(model.pop("vocabulary"))
    asked = [*texts[:12], "", "?!", "one", "x " * 17, "Wörter wie diese " * 30]
    expected = []
    for text in asked:
        words = toxicity.Words([text])
        vectors = toxicity.word_inputs(words, vocabulary.numbers(words.hashes), model)[:-1].astype(float)
        count = len(vectors)
        starts = [0, *range(toxicity.STEP, max(count - toxicity.WINDOW + toxicity.STEP, 0), toxicity.STEP)]
        found = sorted(plain_logit(vectors[a : a + toxicity.WINDOW], model) for a in starts)
        x = np.array([1, found[-1], np.mean(found[-3:]), np.log(len(found))])
        expected.append(1 / (1 + np.exp(-np.clip(x @ model["logistic"], -30, 30))))
    assert toxicity.score(asked, vocabulary, model) == pytest.approx(np.array(expected), abs=2e-3)


def test_any_thirteen_words_lie_in_one_window():
    places, held, firsts = toxicity.Words(["x " * 200]).windows()
    mine = [set(p[p < 200]) for p in places]
    for start in range(200 - 12):
        assert any(set(range(start, start + 13)) <= m for m in mine)
