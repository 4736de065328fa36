import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import curve


def brute_average_precision(pairs):
    positives = sum(y for y, _ in pairs)
    if not positives:
        return None
    area = 0.0
    for cut in sorted({s for _, s in pairs}, reverse=True):
        taken = [y for y, s in pairs if s >= cut]
        here = sum(y for y, s in pairs if s == cut)
        area += here / positives * sum(taken) / len(taken)
    return area


def brute_auc(pairs):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    if not pos or not neg:
        return None
    wins = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg))
    return wins / len(pos) / len(neg)


def cases():
    yield [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)]
    yield [(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)]
    yield [(1, 0.5), (1, 0.4)]
    yield [(0, 0.5), (0, 0.4)]
    rng = random.Random(5)
    yield [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(200)]


@pytest.mark.parametrize("coalesce", ["true", "false"])
@pytest.mark.parametrize("pairs", list(cases()))
def test_against_brute_force(spark, pairs, coalesce):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, coalesce)
    try:
        check(spark, pairs)
    finally:
        spark.conf.set(name, "true")


def check(spark, pairs):
    df = spark.createDataFrame(pairs, "label int, score double")
    ap = curve.average_precision(df, "label", "score").first()[0]
    auc = curve.roc_auc(df, "label", "score").first()[0]
    assert ap == pytest.approx(brute_average_precision(pairs))
    assert auc == pytest.approx(brute_auc(pairs))


def test_precision_at_fraction(spark):
    rows = [(i, int(i < 6), 1.0 - i / 100) for i in range(40)]
    df = spark.createDataFrame(rows, "key int, label int, score double")
    row = curve.precision_at_fraction(df, "label", "score", "key").first()
    assert (row.k, row.base_rate, row.precision_at_k) == (4, 0.15, 1.0)
    assert row.lift_at_k == pytest.approx(1 / 0.15)
    few = curve.precision_at_fraction(df.limit(3), "label", "score", "key").first()
    assert few.k == 1


def test_report_joins_all_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.8), (2, 0, 0.4), (3, 1, 0.4)], "key int, label int, score double")
    row = curve.ranking_report(df, "label", "score", "key").first().asDict()
    assert set(row) == {"k", "base_rate", "precision_at_k", "lift_at_k", "pr_auc", "roc_auc", "brier"}
    assert row["brier"] == pytest.approx((0.04 + 0.16 + 0.36) / 3)
    assert df.agg(curve.brier(F.col("label"), F.col("score"))).first()[0] == pytest.approx(row["brier"])
