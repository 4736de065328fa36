import math
import pickle
from collections import defaultdict

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.boosting import Ensemble, Settings
from tidemark.plans import model, propensity

NAMES = propensity.FEATURES


def walk(nodes, row):
    """Node numbers of a row's way down one tree of the stored table."""
    path = [0]
    while nodes[path[-1]].feature is not None:
        n = nodes[path[-1]]
        value = row[n.feature]
        path.append(n.left if value is None or value < n.edge else n.right)
    return path


def by_tree(table):
    trees = defaultdict(dict)
    for n in table.collect():
        trees[n.tree][n.node] = n
    base = trees.pop(0)[0].value
    return base, [trees[t] for t in sorted(trees)]


def plain_fit(rows, label, spots, settings):
    """Best-first growth, one split at a time, straight from the definition."""
    cells = np.stack([boosting.cells_of(rows[:, f]) for f in range(rows.shape[1])], axis=1)
    cells = np.where(np.isnan(rows), np.iinfo(np.int64).min, cells)
    ends = []
    for f in range(rows.shape[1]):
        own = sorted(c for c, v in zip(cells[:, f], rows[:, f]) if not math.isnan(v))
        steps, seen = [], 0
        for i, c in enumerate(own):
            if i + 1 == len(own) or own[i + 1] != c:
                steps.append((c, ((i + 1) * (boosting.BINS - 1) - 1) // len(own)))
        ends.append([c for (c, a), (_, b) in zip(steps, steps[1:]) if b > a])
    base = float(np.log(label.mean() / (1 - label.mean())))
    score = np.full(len(rows), base)
    found = []
    for number in range(settings.trees):
        share = settings.row_share * (1 << 24)
        mixed = [((int(s) ^ (number + 1)) * 0x9E3779B97F4A7C15) % 2**64 for s in spots]
        mixed = [((m ^ (m >> 31)) * 0x9E3779B97F4A7C15) % 2**64 for m in mixed]
        inside = np.array([(m >> 40) < share for m in mixed])
        chance = 1 / (1 + np.exp(-score))
        g = np.rint((chance - label) * 2**20).astype(np.int64)
        h = np.rint(chance * (1 - chance) * 2**20).astype(np.int64)
        columns = boosting.columns_of(rows.shape[1], number, settings)

        def value(own):
            return -settings.learning_rate * float(g[own].sum()) / float(h[own].sum()) if h[own].sum() > 0 else 0.0

        def split(own):
            best = None
            whole = float(g[own].sum()) ** 2 / max(h[own].sum(), 1)
            for f in columns:
                for edge in [np.iinfo(np.int64).min, *ends[f]]:
                    left = own[cells[own, f] <= edge]
                    right = own[cells[own, f] > edge]
                    if min(len(left), len(right)) < settings.least_rows or not h[left].sum() or not h[right].sum():
                        continue
                    gain = float(g[left].sum()) ** 2 / h[left].sum() + float(g[right].sum()) ** 2 / h[right].sum() - whole
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, f, edge, left, right
            return best

        nodes = {0: (np.flatnonzero(inside), None)}
        open_ = {0: split(nodes[0][0])}
        leaves, sizes = 1, []
        while leaves < settings.leaves:
            able = [(-s[0], n) for n, s in open_.items() if s is not None]
            if not able:
                break
            node = min(able)[1]
            _, f, edge, left, right = open_.pop(node)
            nodes[node] = (nodes[node][0], (f, edge))
            for child, own in ((2 * node + 1, left), (2 * node + 2, right)):
                nodes[child] = (own, None)
                deep = (child + 1).bit_length() - 1 >= settings.depth
                open_[child] = None if deep else split(own)
            leaves += 1
            sizes.append(leaves)
        found.append({n: (rule, value(own), len(own)) for n, (own, rule) in nodes.items()})
        for i in range(len(rows)):
            n = 0
            while nodes[n][1] is not None:
                f, edge = nodes[n][1]
                n = 2 * n + 1 + int(cells[i, f] > edge)
            score[i] += found[-1][n][1]
    return base, found


SMALL = Settings(trees=8, learning_rate=0.2, depth=3, leaves=5, least_rows=4)


@pytest.fixture(scope="module")
def fitted(lake):
    split = lake.split()
    settings = Settings(trees=30, least_rows=5)
    table = model.fit(split.where("is_train").drop("is_train"), settings).persist()
    yield table, Ensemble(table), split.where("NOT is_train").drop("is_train")
    table.unpersist()


def test_trees_equal_those_of_the_definition(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 5))
    rows[:, 1] = rng.integers(0, 4, 300)
    rows[:, 2] = np.where(rng.random(300) < 0.2, np.nan, rng.exponential(100, 300))
    rows[:, 3] = 7.0
    label = (rows[:, 0] + rows[:, 1] + rng.normal(size=300) > 1).astype(int)
    data = [(i, *(None if math.isnan(v) else float(v) for v in r), int(y)) for i, (r, y) in enumerate(zip(rows, label))]
    names = [f"x{i}" for i in range(5)]
    frame = spark.createDataFrame(data, ", ".join(["id long", *(f"{n} double" for n in names), "y int"]))
    spots = [r.s % 2**64 for r in frame.select(F.xxhash64("id").alias("s")).collect()]
    base, trees = by_tree(boosting.fit(frame, names, "y", "id", SMALL))
    plain_base, plain = plain_fit(rows, label, spots, SMALL)
    assert base == plain_base and len(trees) == SMALL.trees
    for got, wanted in zip(trees, plain):
        assert set(got) == set(wanted)
        for n, (rule, value, count) in wanted.items():
            assert got[n].value == value and got[n].rows == count
            assert (got[n].feature is None) == (rule is None)
            if rule:
                assert got[n].feature == names[rule[0]]
                assert boosting.cells_of(np.array([got[n].edge]))[0] == rule[1] + 1 or got[n].edge == -math.inf
    leaves = [sum(n.feature is None for n in t.values()) for t in trees]
    depths = [max((n + 1).bit_length() - 1 for n in t) for t in trees]
    assert max(leaves) == SMALL.leaves and max(depths) == SMALL.depth
    # Both limits bind: three levels have room for more leaves, five leaves for more levels.
    assert any(len(t) == 9 and (max(t) + 1).bit_length() - 1 < SMALL.depth for t in trees) or min(leaves) == SMALL.leaves


def test_trees_do_not_depend_on_blocks_and_tasks(spark, monkeypatch, lake):
    training = lake.split().where("is_train").drop("is_train")
    settings = Settings(trees=3, least_rows=5)
    one = sorted(map(tuple, model.fit(training, settings).collect()), key=repr)
    rounds = []
    inner = boosting._round
    monkeypatch.setattr(boosting, "_round", lambda state, *a: rounds.append(state.rdd.getNumPartitions()) or inner(state, *a))
    monkeypatch.setattr(boosting, "ROUND", 2)
    monkeypatch.setattr(boosting, "_FEW", 2)
    for setting, value in (("advisoryPartitionSizeInBytes", "1k"), ("coalescePartitions.enabled", "false")):
        spark.conf.set(f"spark.sql.adaptive.{setting}", value)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert sorted(map(tuple, model.fit(training, settings).collect()), key=repr) == one
    finally:
        for name in ("adaptive.advisoryPartitionSizeInBytes", "adaptive.coalescePartitions.enabled", "files.maxPartitionBytes"):
            spark.conf.unset(f"spark.sql.{name}")
    assert len(rounds) == 2 and min(rounds) > 2


def test_sums_of_many_tasks_stay_off_the_driver(spark, monkeypatch, lake):
    training = lake.split().where("is_train").drop("is_train")
    sizes = []
    inner = RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: sizes.append(inner(self)) or sizes[-1])
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        model.fit(training, Settings(trees=2, least_rows=2)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sizes) > 2 and max(len(pickle.dumps(found)) for found in sizes) < 1 << 14


def test_scores_are_those_of_the_table(lake, fitted):
    table, ensemble, _ = fitted
    base, trees = by_tree(table)
    rows = {r.user_id: r.asDict() for r in lake.training().collect()}
    for r in model.predict(ensemble, lake.training()).collect():
        odds = base
        for nodes in trees:
            odds += nodes[walk(nodes, rows[r.user_id])[-1]].value
        assert math.isclose(r.prediction_score, 1 / (1 + math.exp(-odds)), rel_tol=1e-12)


def test_contributions_add_up_along_the_paths(fitted):
    table, ensemble, held_out = fitted
    base, trees = by_tree(table)
    rows = {r.user_id: r.asDict() for r in held_out.collect()}
    found = model.contributions(ensemble, held_out).collect()
    assert {r.user_id for r in found} == set(rows)
    for r in found:
        credits, odds = defaultdict(float), base
        for nodes in trees:
            path = walk(nodes, rows[r.user_id])
            odds += nodes[path[-1]].value
            for a, b in zip(path, path[1:]):
                credits[nodes[a].feature] += nodes[b].value - nodes[a].value
        assert all(math.isclose(r[n], credits[n], abs_tol=1e-12) for n in NAMES)
        assert math.isclose(r.base + sum(r[n] for n in NAMES), odds, abs_tol=1e-9)


def test_drivers_cover_every_feature(fitted):
    _, ensemble, held_out = fitted
    rows = model.drivers(ensemble, held_out).collect()
    sizes = defaultdict(list)
    for r in model.contributions(ensemble, held_out).collect():
        for name in NAMES:
            sizes[name].append(abs(r[name]))
    assert {r.feature for r in rows} == set(NAMES) and {r.rows for r in rows} == {held_out.count()}
    assert all(math.isclose(r.mean_abs_contribution, np.mean(sizes[r.feature]), rel_tol=1e-9) for r in rows)


def test_model_beats_the_base_rate(fitted):
    _, ensemble, held_out = fitted
    row = model.evaluate(ensemble, held_out).first()
    assert row.pr_auc > row.base_rate and row.roc_auc > 0.5 and 0 < row.brier < 0.25


def test_one_customer_scores_as_in_the_batch(lake, fitted):
    _, ensemble, _ = fitted
    batch = {r.user_id: r.propensity_score for r in model.score_all(ensemble, lake.training()).collect()}
    assert len(batch) == lake.training().count()
    user = min(batch)
    single = model.predict(ensemble, lake.training().where(f"user_id = {user}")).first()
    assert single.prediction_score == batch[user]


def test_missing_and_strange_values(spark, fitted, lake):
    _, ensemble, _ = fitted
    one = lake.training().limit(1)
    for value in (None, float("nan"), float("inf"), -1e300):
        row = one.withColumn("aov", F.lit(value).cast("double"))
        assert 0 <= model.predict(ensemble, row).first().prediction_score <= 1
    empty = model.fit(lake.training().limit(0), SMALL)
    assert empty.count() == 1 and Ensemble(empty).trees == {}
    same = model.fit(lake.training().withColumn("label_conversion", F.lit(1)), SMALL)
    assert model.predict(Ensemble(same), one).first().prediction_score > 0.99


def test_cells_keep_the_order():
    values = np.array([-np.inf, -1e300, -3.5, -3.4999, -1e-310, 0.0, 1e-310, 0.1, 1, 1.001, 2, 255, 256, 511, 512, 1e300, np.inf])
    cells = boosting.cells_of(values)
    assert (np.diff(cells) >= 0).all()
    assert len(set(boosting.cells_of(np.arange(512.0)))) == 512
    for value, cell in zip(values, cells):
        assert boosting.first_of(cell) <= value < boosting.first_of(cell + 1) or np.isinf(value)
