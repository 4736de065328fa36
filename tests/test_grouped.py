from pyspark.sql import functions as F

from tidemark.operators.grouped import aggregate_with_distinct


def test_equals_one_aggregation_with_null_keys_and_values(spark):
    """A third of the rows under one key; NULL keys, values and amounts occur."""
    number = F.col("id")
    rows = spark.range(0, 9000, numPartitions=4).select(
        F.when(number % 3 == 0, 1).when(number % 11 != 0, number % 50).alias("key"),
        F.when(number % 7 != 0, number % 400).alias("value"),
        F.when(number % 5 != 0, number).alias("amount"),
    )
    sums = {"total": F.sum("amount"), "n": F.count("amount"), "low": F.min("amount")}
    got = aggregate_with_distinct(rows, "key", "value", "values", sums)
    expected = rows.groupBy("key").agg(
        F.count_distinct("value").alias("values"), *[c.alias(n) for n, c in sums.items()]
    )
    assert got.columns == expected.columns
    assert got.count() == expected.count() == 51
    assert got.exceptAll(expected).count() == 0


def test_group_without_values(spark):
    rows = spark.createDataFrame([(1, None, None)], "key int, value int, amount int")
    row = aggregate_with_distinct(rows, "key", "value", "values", {"total": F.sum("amount")}).first()
    assert (row["values"], row.total) == (0, None)
