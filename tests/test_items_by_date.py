"""Order items are stored by date, so a period opens few files."""

from pyspark.sql import functions as F

from tidemark.plans.lakehouse import Lakehouse


def test_files_hold_separate_days(spark, folder, tmp_path):
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # the test table is small enough for one file
    try:
        items = Lakehouse(spark, folder, str(tmp_path)).items()
    finally:
        spark.conf.set(merging, "true")
    ranges = (
        items.groupBy(F.col("_metadata.file_name").alias("file"))
        .agg(F.min("order_date").alias("low"), F.max("order_date").alias("high"))
        .orderBy("low", "high")
        .collect()
    )
    assert len(ranges) > 3
    assert all(a.high <= b.low for a, b in zip(ranges, ranges[1:]))
    last = ranges[-1].high
    half_year = items.where(F.col("order_date") > F.add_months(F.lit(last), -6))
    touched = half_year.select(F.col("_metadata.file_name").alias("f")).distinct().count()
    assert touched < len(ranges) / 2
    assert "PushedFilters: [IsNotNull(order_date), GreaterThan(order_date" in (
        half_year._jdf.queryExecution().executedPlan().toString()
    )


def test_features_alone_store_no_order_items(spark, folder, lake, tmp_path):
    """Until a job asks for the stored items, features join the few columns they need."""
    own = Lakehouse(spark, folder, str(tmp_path / "lake"))
    got = sorted(own.features().collect())
    assert not own.store.has("fact_order_items")
    own.items()
    assert sorted(own.build_features().collect()) == got == sorted(lake.features().collect())
