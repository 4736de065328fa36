import re
from collections import defaultdict

import pytest

from tests.llm.conftest import DOCUMENTS, document
from tidemark.llm import mixing
from tidemark.llm.queries import op10_mixing, QUERIES
from tidemark.llm.sql import statements
from tools.check import compare, connect


def plain_targets(sizes):
    """Share out by weight, cut at three times the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in full]
        over = [s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            full.add(s)
            target[s] = 3.0 * sizes[s]
        left = sum(sizes.values()) - sum(target.values())
    for s in open_:
        target[s] = left * weight[s] / sum(weight[o] for o in open_) if left else 0.0
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5}, {"a": 0, "b": 7}, {"a": 1, "b": 1, "c": 1, None: 10_000}, {"x": 4},
    {f"s{i}": (i * 37) % 50 for i in range(20)},
])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    assert found == pytest.approx(plain_targets(sizes))


def test_query_against_sql(spark, folder):
    name = "op10_mixing"
    state, rows, _, note = compare(spark, connect(folder), name, QUERIES[name], statements()[name], folder)
    assert state == "ok", note


def test_reruns_agree_and_targets_are_met(spark, folder, documents):
    rows = op10_mixing(spark, folder).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op10_mixing(spark, folder).collect()))
    source = {r.doc_id: r.source for r in documents.collect()}
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in documents.collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert target == pytest.approx(plain_targets(sizes))
    largest = defaultdict(int)
    for d, s in size.items():
        largest[source[d]] = max(largest[source[d]], s)
    assert all(target[s] - largest[s] <= taken[s] <= target[s] + 1 for s in sizes)


def test_sampling_order_and_quality(spark):
    docs = [document(i, "w " * 10, source="a") for i in range(3000)]
    docs += [document(10_000 + i, "w " * 10, source="b") for i in range(3000)]
    weights = spark.createDataFrame(
        [(i, 2.0 if i % 2 else 0.5) for i in range(3000)], "doc_id long, quality double"
    )
    rows = mixing.mixed(spark.createDataFrame(docs, DOCUMENTS), weights).collect()
    took = [r.doc_id for r in rows if r.doc_id < 3000 and r.taken]
    # Source a has weight 1 of 3: two thirds of its words, all in the fractional part.
    assert len(took) == 2000
    good = sum(i % 2 for i in took)
    assert good > 1.5 * (len(took) - good)
    b = {r.taken for r in rows if r.doc_id >= 10_000}
    assert b == {10, 20}  # one complete epoch, then a third of a second


def test_awkward_rows(awkward, labels):
    weights = mixing.quality_weights(labels)
    assert {(r.doc_id, r.quality) for r in weights.collect()} == {(1, 2.0), (2, 0.5)}
    rows = mixing.mixed(awkward, weights).collect()
    assert len(rows) == awkward.count()
    assert all(r.size == 0 and r.taken == 0 for r in rows if r.doc_id in (3, 4, 5, 8))
    out = mixing.apply_mix(awkward, weights)
    assert out.columns == awkward.columns
    assert out.count() == sum(r.taken // r.size for r in rows if r.size)


def test_empty_tables(nothing, labels):
    assert mixing.mixed(nothing, mixing.quality_weights(labels.limit(0))).collect() == []
    assert mixing.apply_mix(nothing).collect() == []
