import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordered import (
    equal_frequency_bucket,
    global_rank,
    rank_in_group,
    running_totals,
    top_per_group,
)


@pytest.fixture(scope="module", autouse=True)
def many_slices(spark):
    """Keep small test data in several slices, which run-time coalescing would merge."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


@pytest.fixture(scope="module")
def skewed(spark):
    """One score holds a third of the rows, and one group two thirds."""
    key = F.col("id")
    return spark.range(0, 30_000, numPartitions=7).select(
        key.alias("key"),
        F.when(key % 3 == 0, 0.5).otherwise((key * 7919 % 1000) / 1000.0).alias("score"),
        (key % 3 == 1).cast("int").alias("label"),
    )


def test_global_rank_equals_window(skewed):
    order = [F.col("score").desc(), F.col("key")]
    got = global_rank(skewed, order)
    expected = skewed.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("bigint"))
    assert got.drop("total").exceptAll(expected).count() == 0
    assert got.select("total").distinct().collect()[0].total == 30_000


def test_global_rank_spreads_a_frequent_score(skewed):
    order = [F.col("score"), F.col("key")]
    slices = skewed.repartitionByRange(*order).groupBy(F.spark_partition_id()).count()
    biggest = slices.agg(F.max("count")).first()[0]
    assert slices.count() > 1
    assert biggest < 30_000 / 3


def test_rank_in_group_equals_window(skewed):
    order = [F.col("score"), F.col("key")]
    got = rank_in_group(skewed, "label", [0, 1], order)
    window = W.partitionBy("label")
    expected = skewed.select(
        "*",
        F.row_number().over(window.orderBy(*order)).cast("bigint").alias("rank"),
        F.count(F.lit(1)).over(window).alias("total"),
    )
    assert got.exceptAll(expected).count() == 0
    assert got.count() == 30_000


def test_rank_in_group_rejects_other_groups(skewed):
    with pytest.raises(PySparkException):
        rank_in_group(skewed, "label", [0], [F.col("key")]).count()


def test_running_totals_equal_window(skewed):
    df = skewed.groupBy("score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    got = running_totals(df, [F.col("score").desc()], ["pos", "n"])
    window = W.orderBy(F.col("score").desc())
    expected = df.select(
        "*",
        F.sum("pos").over(window).alias("run_pos"),
        F.sum("n").over(window).alias("run_n"),
        F.lit(10_000).cast("bigint").alias("all_pos"),
        F.lit(30_000).cast("bigint").alias("all_n"),
    )
    assert got.count() == df.count()
    assert got.exceptAll(expected).count() == 0


def test_empty_input(spark):
    df = spark.createDataFrame([], "key bigint, score double")
    assert global_rank(df, [F.col("score"), F.col("key")]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 19, 25, 100, 101])
def test_bucket_equals_quantile_cut(spark, n):
    df = spark.range(1, n + 1).select(
        "id", equal_frequency_bucket(F.col("id"), F.lit(n).cast("bigint")).alias("bucket")
    )
    got = {row.id: row.bucket for row in df.collect()}
    if n == 1:
        assert got == {1: 1}
        return
    cut = pd.qcut(pd.Series(range(1, n + 1)), 10, labels=False) + 1
    assert got == {i + 1: int(b) for i, b in enumerate(cut)}


def test_bucket_sizes_of_the_published_book(spark):
    n = 23_391
    bucket = equal_frequency_bucket(F.col("id"), F.lit(n).cast("bigint"))
    tier = F.when(bucket >= 9, "High").when(bucket >= 5, "Medium").otherwise("Low")
    sizes = {r[0]: r[1] for r in spark.range(1, n + 1).groupBy(tier).count().collect()}
    assert sizes == {"High": 4678, "Medium": 9356, "Low": 9357}


def test_top_per_group(skewed):
    got = top_per_group(skewed, "label", [F.col("score").desc(), F.col("key")], 3).collect()
    assert sorted((r.label, r.place) for r in got) == [(g, p) for g in (0, 1) for p in (1, 2, 3)]
