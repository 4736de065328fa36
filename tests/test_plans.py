"""Properties of physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import lookup
from tidemark.session import shared_dir
from tidemark.sources import retail

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plan joins as for tables too large to broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_lookup_filter_reaches_the_files(lake, no_broadcast):
    text = plan(lookup.next_best_offer(lake.scores(), lake.features(), 5))
    assert text.count("PushedFilters: [IsNotNull(user_id), EqualTo(user_id,5)]") == 2
    assert "monetary_total" not in text
    assert text.count("SelectedBucketsCount: 1 out of") == 2


def test_per_customer_joins_need_no_shuffle(lake, no_broadcast):
    for df in (lake.c360(), lookup.next_best_offer(lake.scores(), lake.features())):
        text = plan(df)
        assert "SortMergeJoin" in text and "Exchange" not in text


def test_features_shuffle_only_to_aggregate(lake, no_broadcast):
    """Four left joins reuse the aggregations' partitioning by customer."""
    text = plan(lake.build_features())
    assert text.count("SortMergeJoin") == 4
    assert "ReadSchema: struct<user_id:int,category:string,material:string>" in text
    # Orders: sums, (customer, order) pairs and their counts. Items: (customer, category)
    # and customer. Carts, wishlists and users: once each. The joins add none.
    assert text.count("Exchange hashpartitioning(user_id") == 8


def test_frequent_part_is_split_at_run_time(spark, lake, folder, tmp_path, no_broadcast):
    """A part in a third of all lines: its partition of the join is divided among tasks."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    hot = F.when(F.col("l_linenumber") % 3 == 0, F.lit(1)).otherwise(F.col("l_partkey"))
    lines.withColumn("l_partkey", hot.cast("bigint")).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("orders", "part"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        items = retail.order_items(spark, str(tmp_path))
        assert len(items.collect()) == lines.count()
        assert "skew=true" in plan(items)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_top_prospects_are_cut_before_the_shuffle(lake):
    text = plan(lookup.top_prospects_by_segment(lake.scores(), 5))
    assert text.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan(lookup.top_prospects(lake.scores(), "High", 5))


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
