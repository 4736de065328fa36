import pytest
from pyspark.sql import functions as F

from tidemark.plans.features import customer_features
from tidemark.sources import retail
from tidemark.sources.tables import TableStore
from tidemark.streaming.ingest import Medallion
from tidemark.streaming.state import KeyedState


@pytest.fixture()
def state(spark, tmp_path):
    measures = {
        "total": ("sum", F.col("amount")),
        "first": ("min", F.col("day")),
        "last": ("max", F.col("day")),
    }
    return KeyedState(TableStore(spark, str(tmp_path)), "s", "k", measures, {"orders": "o", "days": "day"}, buckets=8)


def frame(spark, batch):
    rows = spark.createDataFrame(batch, "k int, o long, amount int, day int")
    return rows.withColumn("amount", F.col("amount").cast("decimal(10,2)"))


def expected(spark, batches):
    rows = frame(spark, [r for b in batches for r in b]).where("k IS NOT NULL")
    return rows.groupBy("k").agg(
        F.sum("amount").alias("total"),
        F.min("day").alias("first"),
        F.max("day").alias("last"),
        F.count_distinct("o").alias("orders"),
        F.count_distinct("day").alias("days"),
    )


def same(found, wanted):
    pick = sorted(wanted.columns)
    return sorted(map(str, found.select(pick).collect())) == sorted(map(str, wanted.select(pick).collect()))


BATCHES = [
    [(1, 10, 5, 3), (1, 10, 2, 4), (2, 11, 1, 9), (3, None, None, None)] + [(7, n, 1, n % 5) for n in range(200)],
    [(1, 10, 1, 1), (1, 12, None, 3), (None, 5, 1, 1)],
    [],
    [(2, 11, 3, 9), (3, 13, 1, 2), (9, 1, 1, 1)] + [(7, n, 1, n % 7) for n in range(100, 300)],
]


def test_merged_equals_recomputed(spark, state):
    for number, batch in enumerate(BATCHES):
        state.merge(frame(spark, batch), number)
        assert same(state.read(), expected(spark, BATCHES[: number + 1]))


def test_only_buckets_of_the_batch_are_written(spark, state):
    state.merge(frame(spark, [(k, k, 1, 1) for k in range(100)]), 0)
    assert set(state.manifest().values()) == {0} and len(state.manifest()) == 9
    state.merge(frame(spark, [(5, 900, 1, 2), (5, 5, 1, 2)]), 1)
    newer = [b for b, v in state.manifest().items() if v == 1 and b >= 0]
    assert len(newer) == 1
    files = {f.split("/")[-2] for f in state.read().where("k <> 5").inputFiles() if "version=0" in f}
    assert len(files) == 7
    assert state.read().where("k = 5").first().orders == 2


def test_a_repeated_or_broken_off_batch_counts_once(spark, state, monkeypatch):
    state.merge(frame(spark, BATCHES[0]), 0)
    with monkeypatch.context() as broken:
        broken.setattr(state.store, "replace", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            state.merge(frame(spark, BATCHES[1]), 1)
    assert same(state.read(), expected(spark, BATCHES[:1]))
    for _ in range(2):
        state.merge(frame(spark, BATCHES[1]), 1)
    assert same(state.read(), expected(spark, BATCHES[:2]))


def test_old_versions_go(spark, state, tmp_path):
    for number in range(6):
        state.merge(frame(spark, [(1, number, 1, number)]), number)
    kept = [p for p in (tmp_path / "s_rows").glob("version=*/bucket=*")]
    assert len(kept) == 2 and state.read().first().orders == 6


def test_gold_merged_with_late_rows(lake, spark, tmp_path):
    medallion = Medallion(spark, str(tmp_path / "medallion"))
    early = F.col("order_date") < "1995-01-01"
    parts = [
        ("orders_bronze", lake.orders_raw(), retail.ORDERS_RAW_SCHEMA, early),
        ("items_bronze", lake.items(), retail.ORDER_ITEMS_SCHEMA, early),
        ("users_bronze", lake.users(), retail.USERS_SCHEMA, F.col("user_id") % 2 == 0),
    ]
    # The later rows come first, so the second landing is late as a whole.
    for late in (False, True):
        for name, rows, schema, chosen in parts:
            chosen = F.coalesce(chosen, F.lit(True))
            landing = str(tmp_path / "landing" / name)
            rows.where(chosen if late else ~chosen).write.mode("append").json(landing)
            medallion.ingest(landing, name, schema)
        medallion.merge_gold("orders_bronze", "items_bronze", "users_bronze")
        medallion.split("orders_bronze")
        wanted = customer_features(
            medallion.silver(), medallion.store.read("items_bronze"), medallion.store.read("users_bronze")
        )
        found = medallion.merged_gold().select(wanted.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    before = medallion.states()["orders"].manifest()
    medallion.merge_gold("orders_bronze", "items_bronze", "users_bronze")
    assert medallion.states()["orders"].manifest() == before
