import pytest
from pyspark.sql import functions as F

from tidemark.operators.boosting import Settings
from tidemark.operators.profile import profile
from tidemark.operators.upsert import upsert
from tidemark.plans import lookup, model, propensity, publish
from tidemark.plans.lakehouse import Lakehouse
from tidemark.plans.views import named_views
from tidemark.sources.tables import TableStore


def test_upsert(spark):
    schema = "key int, a string, b double, at string"
    old = spark.createDataFrame([(1, "x", 1.0, "old"), (2, "y", 2.0, "old")], schema)
    new = spark.createDataFrame([(2, None, 3.0), (3, "z", 4.0)], "key int, a string, b double")
    rows = upsert(old, new, "key", ["a", "b"], ("at", F.lit("new"))).orderBy("key").collect()
    assert [tuple(r) for r in rows] == [
        (1, "x", 1.0, "old"),
        (2, None, 3.0, "new"),
        (3, "z", 4.0, "new"),
    ]


def test_upsert_again_changes_nothing(spark):
    new = spark.createDataFrame([(2, "q"), (3, "z")], "key int, a string")
    old = spark.createDataFrame([(1, "x"), (2, "y")], "key int, a string")
    once = upsert(old, new, "key", ["a"])
    twice = upsert(once, new, "key", ["a"])
    assert once.exceptAll(twice).count() == 0 and once.count() == twice.count() == 3


def test_sync_serving_keeps_old_rows_and_old_versions(spark, lake, tmp_path):
    store = TableStore(spark, str(tmp_path))
    gone = spark.sql("SELECT -1 AS user_id, 0.5D AS propensity_score, 'Low' AS segment, 1 AS decile, current_timestamp() AS scored_at")
    publish.first_serving(store, "scores", gone)
    for _ in range(3):
        table = publish.sync_serving(store, "scores", lake.scores())
        assert table.count() == lake.scores().count() + 1
    # Older versions are gone, folder and catalog entry alike.
    assert store.complete_versions("scores") == [3, 4]
    assert len([t for t in spark.catalog.listTables() if t.name.startswith("scores_")]) == 2
    # Old and new rows meet in place, and another store opens the buckets again.
    files = [f for f in table.inputFiles()]
    assert len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    again = TableStore(spark, str(tmp_path)).read_bucketed("scores", "user_id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, table.collect()))
    assert again.where("user_id = -1").count() == 1
    every_bucket_right = again.join(table.select("user_id"), "user_id")
    assert every_bucket_right.count() == table.count()


def test_sync_shuffles_new_scores_alone(spark, lake, tmp_path):
    store = TableStore(spark, str(tmp_path))
    publish.first_serving(store, "scores", publish.serving_projection(lake.scores()).withColumn("scored_at", F.current_timestamp()))
    loose = lake.scores().select("*").repartition(3)
    plan = publish.sync_scores(store.read_bucketed("scores", "user_id"), loose)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sync_check(lake):
    rows = publish.sync_check(lake.scores()).collect()
    assert sum(r.customers for r in rows) == rows[0].synced_rows == lake.scores().count()


def test_merge_statement():
    text = publish.merge_statement("staging", "serving")
    assert "ON CONFLICT (user_id) DO UPDATE" in text and "scored_at = now()" in text


def test_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.replace("t", spark.range(3))
    assert store.replace("t", spark.range(2).withColumn("more", F.lit("x"))).columns == ["id", "more"]
    store.append("t", spark.range(1).withColumn("more", F.lit("y")))
    assert store.read("t").count() == 3
    first = store.write_version("v", 9, spark.range(2))
    second = store.write_version("v", 10, first.withColumn("id", F.col("id") + 10))
    assert sorted(r.id for r in second.collect()) == [10, 11]
    assert store.latest_version("v") == 10
    assert store.read_version("v", 9).count() == 2


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "b")], "n int, s string")
    rows = {r.column_name: r for r in profile(df).collect()}
    assert set(rows) == {"n", "s", ":table"}
    assert (rows["n"].null_count, rows["n"].distinct_count, rows["n"].mean, rows["n"].max_number) == (1, 2, 2.0, 3.0)
    assert (rows["s"].distinct_count, rows["s"].min_text, rows["s"].max_text) == (2, "a", "b")
    assert (rows[":table"].row_count, rows[":table"].distinct_count) == (3, None)
    plan = profile(df.join(df.select(F.col("n").alias("m")).distinct(), F.col("n") == F.col("m")))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    empty = {r.column_name: r for r in profile(df.limit(0)).collect()}
    assert empty["n"].distinct_count == 0 and empty[":table"].row_count == 0


def test_broken_off_versions_are_passed_over(spark, lake, tmp_path):
    store = TableStore(spark, str(tmp_path))
    first = "SELECT CAST(id AS INT) AS user_id, 0.5D AS propensity_score, 'Low' AS segment, 1 AS decile, current_timestamp() AS scored_at FROM range(1000000, 1001000)"
    publish.first_serving(store, "scores", spark.sql(first))
    half = tmp_path / "scores" / "version=2"
    spark.range(3).write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    (tmp_path / "scores" / "version=3" / "_temporary").mkdir(parents=True)
    assert store.latest_version("scores") == 1
    assert publish.sync_serving(store, "scores", lake.scores()).count() == 1000 + lake.scores().count()
    assert store.latest_version("scores") == 4


def test_replace_keeps_the_old_table_until_the_new_one_is_there(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.replace("t", spark.range(5))
    broken = spark.range(5).withColumn("x", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception):
        store.replace("t", broken)
    assert store.read("t").count() == 5
    reader = store.read("t")
    store.replace("t", spark.range(2))
    assert reader.count() == 5 and store.read("t").count() == 2


def test_another_lakehouse_opens_the_stored_tables(spark, folder, tmp_path):
    first = Lakehouse(spark, folder, str(tmp_path))
    scores = sorted(map(tuple, first.scores().collect()))
    files = {p for p in tmp_path.rglob("*.parquet")}
    second = Lakehouse(spark, folder, str(tmp_path))
    assert sorted(map(tuple, second.scores().collect())) == scores
    assert second.items().count() == first.items().count()
    joined = second.c360()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in joined
    assert {p for p in tmp_path.rglob("*.parquet")} == files


def test_model_scores_reach_offers_and_views(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(model.fit, "__defaults__", (Settings(trees=3),))
    lake = Lakehouse(spark, folder, str(tmp_path), scorer="model")
    scores = lake.scores()
    assert scores.count() == lake.training().count() and scores.where("scored_at IS NULL").count() == 0
    predicted = model.score_all(lake.model(), lake.training()).select("user_id", "propensity_score")
    assert lake.c360().select("user_id", "propensity_score").exceptAll(predicted).count() == 0
    assert lookup.next_best_offer(scores, lake.features()).count() == scores.count()
    cards = lookup.customer_cards(lake.features(), scores, lake.drivers(), "mean_abs_contribution")
    assert len(cards.first().why_top_drivers) == lookup.CARD_DRIVERS
    assert named_views(lake)["nbo_model_drivers"].count() == len(propensity.FEATURES)
