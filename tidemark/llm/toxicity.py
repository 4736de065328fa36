"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A text is cut into words (lower-cased runs of letters, digits and non-ASCII signs) and
these into windows of ``WINDOW`` words, each beginning ``STEP`` words after the last, so
that every word is in two, but at the ends, and any 13 words in a row lie in one. A word
enters as the vector of the word itself, if it is among the ``MOST_WORDS`` commonest of
the learning sample, beside the mean of the vectors of its byte trigrams. One gated recurrent layer reads the window
forwards, one backwards; attention weighs their states, and a linear layer gives the
window's logit. The document's score is a logistic function of its largest logit, the
mean of its three largest, and the logarithm of the number of windows.

The network is trained in numpy, on one executor, from a sample of at most ``SAMPLE``
documents of each label, chosen by a hash of their id. Labels are given for documents:
of a toxic one, training takes the windows that score highest, of the others the highest
and some at random. A quarter of the sample is set apart for the logistic function, in
which the labels count by their share among all learning rows.

Null and empty texts and texts without a word are one empty window. Where either label
is missing from the learning rows nothing is learned and every score is 0. Documents with
several labels count as toxic if one says so; repeated documents count once. A text's
score depends on the text alone; very long texts are scored whole, in slabs of windows.
Extra columns are not read, an empty table gives no row.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, held_out, prepare

#: Words of a window, and from one window to the next: when scoring, and when learning.
WINDOW, STEP, LEARNING_STEP = 24, 12, 16
STATE = 8
WORD_SIZE = TRIGRAM_SIZE = 8
TRIGRAM_BUCKETS = 4096
MOST_WORDS = 4096
#: Most documents of each label in the learning sample.
SAMPLE = 2000
LEAST_SCORE = 0.7
#: Epochs, or more where the sample is too small for so many steps.
_EPOCHS, _STEPS, _BATCH, _RATE = 8, 400, 128, 0.01
_SLAB = 1024
_SLOTS = 1 << 18

Weights = dict[str, np.ndarray]


@lru_cache(maxsize=1)
def _word_bytes() -> np.ndarray:
    return np.array([chr(b).isalnum() or b >= 128 for b in range(256)])


class Words:
    """The words of some texts: hashes, trigram buckets, and each text's share of them."""

    def __init__(self, texts: list[str]) -> None:
        raw = [t.lower().encode() for t in texts]
        data = np.frombuffer(b" " + b" ".join(raw) + b"  ", np.uint8)
        inside = _word_bytes()[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        signs = np.where(inside, data, 0).astype(np.uint32)
        places = np.flatnonzero(inside)
        mixed = (signs[places - 1] * 31 + signs[places]) * 257 + signs[places + 1]
        mixed = mixed * np.uint32(2654435761)
        self.trigrams = (mixed >> np.uint32(20)).astype(np.int32)
        self.lengths = ends - starts
        self.first = np.cumsum(self.lengths) - self.lengths
        order = (places - np.repeat(starts, self.lengths) + 1).astype(np.uint32)
        weighed = (mixed.astype(np.uint64) + np.uint64(1)) * (
            order.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        )
        self.hashes = (
            np.add.reduceat(weighed, self.first) if len(starts) else np.zeros(0, np.uint64)
        ) >> np.uint64(8)
        begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
        self.bounds = np.searchsorted(starts, begins)

    def part(self, places: np.ndarray) -> Words:
        """These words alone, without texts and windows."""
        found = object.__new__(Words)
        found.hashes, found.lengths = self.hashes[places], self.lengths[places]
        found.first = np.cumsum(found.lengths) - found.lengths
        shift = np.repeat(self.first[places] - found.first, found.lengths)
        found.trigrams = self.trigrams[np.arange(len(shift)) + shift]
        return found

    def windows(self, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word places of each window, its number of words, first window of each text)."""
        sizes = np.diff(self.bounds)
        counts = np.maximum(1, -(-np.maximum(sizes - (WINDOW - step), 0) // step))
        firsts = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(sizes)), counts)
        begin = (np.arange(len(owner)) - firsts[owner]) * step
        held = np.clip(sizes[owner] - begin, 0, WINDOW)
        places = (self.bounds[owner] + begin)[:, None] + np.arange(WINDOW)
        # Places behind the end point to an extra row of zeros.
        return np.where(np.arange(WINDOW) < held[:, None], places, len(self.hashes)), held, firsts


class Vocabulary:
    """Number of each known word, found by its hash; 0 for all others."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.table = np.zeros(_SLOTS, np.int32)
        self.hashes = np.concatenate([np.zeros(1, np.uint64), hashes.astype(np.uint64)])
        # Of words that share a slot, the commonest (the first) stays known.
        slots = (self.hashes[1:] & np.uint64(_SLOTS - 1)).astype(np.int64)
        self.table[slots[::-1]] = np.arange(len(hashes), 0, -1)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        found = self.table[(hashes & np.uint64(_SLOTS - 1)).astype(np.int64)]
        return np.where(self.hashes[found] == hashes, found, 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    # exp is several times as fast as tanh; beyond the limits nothing changes.
    return 1 / (1 + np.exp(np.clip(-x, -30, 30)))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 * _sigmoid(2 * x) - 1


def new_weights(words: int, seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    size = WORD_SIZE + TRIGRAM_SIZE
    weights = {
        "words": (rng.standard_normal((words + 1, WORD_SIZE)) * 0.1).astype(np.float32),
        "trigrams": (rng.standard_normal((TRIGRAM_BUCKETS, TRIGRAM_SIZE)) * 0.3).astype(np.float32),
        "out": draw(2 * STATE),
        "out0": np.zeros(1, np.float32),
        "look": draw(2 * STATE, 2 * STATE),
        "ask": draw(2 * STATE),
    }
    for way in ("f", "b"):
        weights[f"in_{way}"] = draw(size, 3 * STATE)
        weights[f"in0_{way}"] = np.zeros(3 * STATE, np.float32)
        weights[f"gates_{way}"] = draw(STATE, 2 * STATE)
        weights[f"new_{way}"] = draw(STATE, STATE)
    return weights


def word_inputs(words: Words, numbers: np.ndarray, weights: Weights) -> np.ndarray:
    """Vector of every word, and a row of zeros."""
    rows = np.zeros((len(numbers) + 1, WORD_SIZE + TRIGRAM_SIZE), weights["words"].dtype)
    rows[:-1, :WORD_SIZE] = weights["words"][numbers] * (numbers > 0)[:, None]
    if len(numbers):
        summed = np.add.reduceat(weights["trigrams"][words.trigrams], words.first, axis=0)
        rows[:-1, WORD_SIZE:] = summed / words.lengths[:, None]
    return rows


def _run(
    rows: np.ndarray, at: np.ndarray, held: np.ndarray, weights: Weights, way: str, keep: list | None = None
) -> np.ndarray:
    """States (place, window, STATE) of one direction over the words ``at`` (place, window)."""
    length, count = at.shape
    inputs = rows @ weights[f"in_{way}"] + weights[f"in0_{way}"]
    gates, new = weights[f"gates_{way}"], weights[f"new_{way}"]
    states = np.empty((length, count, STATE), rows.dtype)
    h = np.zeros((count, STATE), rows.dtype)
    for t in range(length) if way == "f" else range(length - 1, -1, -1):
        a = inputs.take(at[t], axis=0)
        g = _sigmoid(a[:, : 2 * STATE] + h @ gates)
        z, r = g[:, :STATE], g[:, STATE:]
        hn = h @ new
        n = _tanh(a[:, 2 * STATE :] + r * hn)
        live = (t < held)[:, None]
        after = n + z * (h - n)
        if not live.all():
            after = np.where(live, after, h)
        if keep is not None:
            keep.append((t, h, z, r, hn, n, live))
        h = states[t] = after
    return states


def _attend(states: np.ndarray, held: np.ndarray, weights: Weights) -> tuple[np.ndarray, ...]:
    length = len(states)
    seen = _tanh(states @ weights["look"])
    marks = seen @ weights["ask"]
    marks[np.arange(length)[:, None] >= np.maximum(held, 1)] = -30.0
    share = np.exp(marks - marks.max(axis=0))
    share /= share.sum(axis=0)
    pooled = (share[..., None] * states).sum(axis=0)
    return pooled @ weights["out"] + weights["out0"], pooled, share, seen


def logits(
    words: Words, numbers: np.ndarray, weights: Weights, step: int = STEP
) -> tuple[np.ndarray, np.ndarray]:
    """Logit of every window, and the first window of each text."""
    places, held, firsts = words.windows(step)
    rows = word_inputs(words, numbers, weights)
    found = np.zeros(len(places), np.float32)
    for low in range(0, len(places), _SLAB):
        part, count = places[low : low + _SLAB], held[low : low + _SLAB]
        # The windows of a slab cover a run of words; the row of zeros is added to it.
        begin, end = part[:, 0].min(), min(part.max() + 1, len(rows) - 1)
        near = np.concatenate([rows[begin:end], rows[-1:]])
        at = np.ascontiguousarray(np.where(part < len(rows) - 1, part - begin, end - begin).T)
        states = np.concatenate([_run(near, at, count, weights, w) for w in "fb"], axis=2)
        found[low : low + _SLAB] = _attend(states, count, weights)[0]
    return found, firsts


def gradients(
    words: Words, numbers: np.ndarray, places: np.ndarray, held: np.ndarray, labels: np.ndarray, weights: Weights
) -> tuple[float, Weights]:
    """Mean logistic loss of some windows, and its gradient."""
    used, at = np.unique(places, return_inverse=True)
    at, count = np.ascontiguousarray(at.reshape(places.shape).T), len(places)
    if used[-1] == len(words.hashes):
        used = used[:-1]
    words, numbers = words.part(used), numbers[used]
    rows = word_inputs(words, numbers, weights)
    x = rows[at]
    keep: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate(
        [_run(rows, at, held, weights, w, keep[w]) for w in "fb"], axis=2
    )
    logit, pooled, share, seen = _attend(states, held, weights)
    p = _sigmoid(logit)
    loss = float(np.mean(np.logaddexp(0, np.where(labels > 0, -logit, logit))))
    d_logit = ((p - labels) / count).astype(np.float32)
    g: Weights = {"out": pooled.T @ d_logit, "out0": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * weights["out"]
    d_states = share[..., None] * d_pooled
    d_share = np.einsum("cd,lcd->lc", d_pooled, states)
    d_marks = share * (d_share - (share * d_share).sum(axis=0))
    g["ask"] = np.einsum("lc,lcd->d", d_marks, seen)
    d_seen = d_marks[..., None] * weights["ask"] * (1 - seen**2)
    flat = lambda v: v.reshape(-1, v.shape[-1])
    g["look"] = flat(states).T @ flat(d_seen)
    d_states = d_states + d_seen @ weights["look"].T
    d_x = np.zeros_like(x)
    for k, w in enumerate("fb"):
        gates, new = weights[f"gates_{w}"], weights[f"new_{w}"]
        g_gates, g_new = np.zeros_like(gates), np.zeros_like(new)
        d_in = np.zeros((*x.shape[:2], 3 * STATE), np.float32)
        d_h = np.zeros((count, STATE), np.float32)
        for t, h, z, r, hn, n, live in reversed(keep[w]):
            d_h = d_h + d_states[t, :, k * STATE : (k + 1) * STATE]
            d = d_h * live
            d_n = d * (1 - z) * (1 - n**2)
            d_zr = np.concatenate([d * (h - n) * z * (1 - z), d_n * hn * r * (1 - r)], axis=1)
            d_hn = d_n * r
            g_gates += h.T @ d_zr
            g_new += h.T @ d_hn
            d_in[t, :, : 2 * STATE], d_in[t, :, 2 * STATE :] = d_zr, d_n
            d_h = d_h * ~live + d * z + d_zr @ gates.T + d_hn @ new.T
        g[f"gates_{w}"], g[f"new_{w}"] = g_gates, g_new
        g[f"in_{w}"], g[f"in0_{w}"] = flat(x).T @ flat(d_in), flat(d_in).sum(axis=0)
        d_x += d_in @ weights[f"in_{w}"].T
    d_rows = np.zeros_like(rows)
    np.add.at(d_rows, at.ravel(), flat(d_x))
    g["words"] = np.zeros_like(weights["words"])
    known = numbers > 0
    np.add.at(g["words"], numbers[known], d_rows[:-1][known][:, :WORD_SIZE])
    g["trigrams"] = np.zeros_like(weights["trigrams"])
    each = d_rows[:-1, WORD_SIZE:] / np.maximum(words.lengths, 1)[:, None]
    touched = np.repeat(np.any(d_rows[:-1] != 0, axis=1), words.lengths)
    np.add.at(g["trigrams"], words.trigrams[touched], np.repeat(each, words.lengths, axis=0)[touched])
    return loss, g


def summary(found: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Of each text: 1, largest logit, mean of the three largest, log of their number."""
    ends = np.append(firsts[1:], len(found))
    rows = np.ones((len(firsts), 4))
    for i, (a, b) in enumerate(zip(firsts, ends)):
        top = np.sort(found[a:b])[-3:] if b - a <= 3 else np.partition(found[a:b], -3)[-3:]
        rows[i, 1:] = top.max(), top.mean(), np.log(b - a)
    return rows


def _fit_logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, slightly held back."""
    w = np.zeros(x.shape[1])
    hold = np.diag([1e-6, *[0.02] * (x.shape[1] - 1)]) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + hold @ w
        bend = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + hold
        w -= np.clip(np.linalg.solve(bend, slope), -5, 5)
    return w


def train(texts: list[str], toxic: np.ndarray, base_rate: float, epochs: int | None = None) -> bytes:
    """Network and logistic function as a numpy archive."""
    rng = np.random.default_rng(11)
    order = rng.permutation(len(texts))
    apart = np.zeros(len(texts), bool)
    for label in (0, 1):
        apart[order[toxic[order] == label][::4]] = True
    learn = np.flatnonzero(~apart) if len(set(toxic[~apart])) == 2 else np.arange(len(texts))
    test = np.flatnonzero(apart) if len(set(toxic[apart])) == 2 else np.arange(len(texts))
    words = Words([texts[i] for i in learn])
    labels = toxic[learn].astype(np.float32)
    owner_of_word = np.repeat(np.arange(len(learn)), np.diff(words.bounds))
    pairs = np.unique(np.stack([words.hashes, owner_of_word.astype(np.uint64)], 1), axis=0)
    distinct, docs = np.unique(pairs[:, 0], return_counts=True)
    common = distinct[np.argsort(-docs, kind="stable")][: min(MOST_WORDS, int((docs >= 3).sum()))]
    vocabulary = Vocabulary(common)
    numbers = vocabulary.numbers(words.hashes)
    weights = new_weights(len(common))
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    places, held, firsts = words.windows(LEARNING_STEP)
    ends = np.append(firsts[1:], len(places))
    # About five windows of each document make an epoch.
    epochs = epochs or max(_EPOCHS, min(40, -(-_STEPS * _BATCH // (5 * max(len(learn), 1)))))
    steps = 0
    for epoch in range(epochs):
        if epoch % 2:
            found = logits(words, numbers, weights, LEARNING_STEP)[0]
        elif not epoch:
            found = rng.random(len(places))
        chosen = []
        for i, (a, b) in enumerate(zip(firsts, ends)):
            best = a + np.argsort(-found[a:b], kind="stable")[: 3 if labels[i] else 2]
            chosen.append(np.unique(np.append(best, rng.integers(a, b, 0 if labels[i] and epoch else 2))))
        owner = np.repeat(np.arange(len(firsts)), [len(c) for c in chosen])
        chosen = np.concatenate(chosen)
        shuffled = rng.permutation(len(chosen))
        for low in range(0, len(chosen), _BATCH):
            part = shuffled[low : low + _BATCH]
            _, g = gradients(words, numbers, places[chosen[part]], held[chosen[part]],
                             labels[owner[part]], weights)
            steps += 1
            rate = _RATE * (1 - epoch / (epochs + 1))
            for k, value in g.items():
                first[k] = 0.9 * first[k] + 0.1 * value
                second[k] = 0.99 * second[k] + 0.01 * value**2
                step = first[k] / (1 - 0.9**steps) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-8)
                weights[k] = (weights[k] - rate * step).astype(np.float32)
    words = Words([texts[i] for i in test])
    x = summary(*logits(words, vocabulary.numbers(words.hashes), weights))
    y = toxic[test].astype(float)
    share = np.where(y > 0, base_rate / y.mean(), (1 - base_rate) / (1 - y.mean()))
    packed = io.BytesIO()
    np.savez(packed, vocabulary=common, logistic=_fit_logistic(x, y, share), **weights)
    return packed.getvalue()


def score(texts: list[str], vocabulary: Vocabulary, weights: Weights) -> np.ndarray:
    words = Words(texts)
    x = summary(*logits(words, vocabulary.numbers(words.hashes), weights))
    return 1 / (1 + np.exp(-np.clip(x @ weights["logistic"], -30, 30)))


def learning_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float] | None:
    """(text, toxic) of at most SAMPLE documents of each label, and the share of toxic ones."""
    known = (
        labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if set(counts) != {0, 1}:
        return None
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 SAMPLE rows of two numbers, so a broadcast is bounded.
    texts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
    )
    return texts, counts[1] / (counts[0] + counts[1])


def learn(docs: DataFrame, labels: DataFrame) -> bytes | None:
    """The trained model, or nothing if there is none to be learned."""
    prepare(docs.sparkSession)
    sample = learning_sample(docs, labels)
    if sample is None:
        return None
    rows, rate = sample

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        toxic = part["toxic"].to_numpy()
        if len(set(toxic)) < 2:
            return pd.DataFrame({"model": []})
        return pd.DataFrame({"model": [train([t or "" for t in part["text"]], toxic, rate)]})

    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "model binary").collect()
    return bytes(found[0].model) if found else None


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= LEAST_SCORE) of every document."""
    model = learn(docs, labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = dict(np.load(io.BytesIO(model))) if model else None
        vocabulary = Vocabulary(weights.pop("vocabulary")) if weights else None
        for batch, texts in arrow_rows(batches):
            found = score(texts, vocabulary, weights) if weights else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"]
            )

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        judge, "doc_id long, score double"
    )
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"),
    )
