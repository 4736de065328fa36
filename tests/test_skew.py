import pytest
from pyspark.sql import functions as F

from tidemark.operators.skew import frequent_keys, lookup_join


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows ask for one key, a sixth for none; some keys are unknown."""
    number = F.col("id")
    key = (
        F.when(number % 3 == 0, 5)
        .when(number % 6 == 1, F.lit(None))
        .otherwise(number % 4000)
        .cast("int")
    )
    return spark.range(0, 12_000, numPartitions=5).select(number.alias("row"), key.alias("key"))


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(3000).select(
        F.col("id").cast("int").alias("key"), (F.col("id") * 10).alias("value")
    )


def test_equals_plain_join(rows, table):
    got = lookup_join(rows, table, "key").select("row", "key", "value")
    expected = rows.join(table, "key", "left").select("row", "key", "value")
    assert got.count() == rows.count()
    assert got.exceptAll(expected).count() == 0


def test_frequent_keys(rows):
    assert [r.key for r in frequent_keys(rows, "key").collect()] == [5]


def test_no_frequent_keys(spark, table):
    even = spark.range(2000).select(F.col("id").cast("int").alias("key"))
    assert frequent_keys(even, "key").count() == 0
    assert lookup_join(even, table, "key").where("value IS NULL").count() == 0


def test_no_rows(spark, table):
    none = spark.createDataFrame([], "row bigint, key int")
    assert lookup_join(none, table, "key").count() == 0


def test_frequent_keys_do_not_reach_the_shuffle(spark, rows, table):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        joined = lookup_join(rows, table, "key")
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert text.count("SortMergeJoin") == 1
        assert "isnull(__hot" in text
    finally:
        spark.conf.set(name, before)
