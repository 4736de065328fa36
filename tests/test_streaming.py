import json
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import quality
from tidemark.plans.features import customer_features
from tidemark.sources import retail
from tidemark.sources.tables import TableStore, scan
from tidemark.streaming import gateway
from tidemark.streaming.ingest import RESCUED, UNREADABLE, Medallion, typed_lines


@pytest.fixture(scope="module")
def streamed(lake, spark, tmp_path_factory):
    landing = str(tmp_path_factory.mktemp("landing") / "orders")
    lake.orders_raw().repartition(3).write.json(landing)
    medallion = Medallion(spark, str(tmp_path_factory.mktemp("medallion")))
    medallion.ingest(landing, "orders_bronze", retail.ORDERS_RAW_SCHEMA)
    medallion.split("orders_bronze")
    return medallion, landing


def test_stream_equals_batch(lake, streamed):
    medallion, _ = streamed
    rules = quality.order_rules()
    silver = quality.silver_orders(quality.clean(lake.orders_raw(), rules))
    held = quality.quarantine(lake.orders_raw(), rules)
    assert medallion.silver().exceptAll(silver).count() == 0
    assert medallion.silver().count() == silver.count()
    quarantined = medallion.quarantined().select(*held.columns)
    assert quarantined.exceptAll(held).count() == 0 and quarantined.count() == held.count()
    counts = quality.violation_counts(lake.orders_raw(), rules)
    assert medallion.violations().exceptAll(counts).count() == 0


def test_bronze_names_its_files(streamed):
    medallion, _ = streamed
    bronze = medallion.store.read("orders_bronze")
    assert bronze.select("_source_file").distinct().count() == 3
    assert bronze.where("_bronze_ingested_at IS NULL").count() == 0


def test_gold_from_stream_equals_gold_from_batch(lake, spark, streamed, tmp_path):
    medallion, _ = streamed
    for name, df, schema in [
        ("items", lake.items(), retail.ORDER_ITEMS_SCHEMA),
        ("users", lake.users(), retail.USERS_SCHEMA),
    ]:
        df.write.json(str(tmp_path / name))
        medallion.ingest(str(tmp_path / name), f"{name}_bronze", schema)
    gold = medallion.refresh_gold("items_bronze", "users_bronze")
    batch = customer_features(medallion.silver(), lake.items(), lake.users())
    assert gold.count() == batch.count()
    assert gold.exceptAll(batch).count() == 0


def test_rerun_adds_nothing_and_new_files_are_added_once(streamed):
    medallion, landing = streamed
    before = medallion.silver().count(), medallion.quarantined().count()
    for _ in range(2):
        medallion.ingest(landing, "orders_bronze", retail.ORDERS_RAW_SCHEMA)
        medallion.split("orders_bronze")
    assert (medallion.silver().count(), medallion.quarantined().count()) == before
    late = [
        {"order_id": 10_000_001, "user_id": 1, "total_amount": 5.25, "status": "O", "order_date": "2001-01-01"},
        {"order_id": 10_000_002, "user_id": 1, "total_amount": None, "status": "O", "order_date": "2001-01-01"},
    ]
    with open(f"{landing}/late.json", "w") as out:
        out.write("\n".join(json.dumps(row) for row in late))
    medallion.ingest(landing, "orders_bronze", retail.ORDERS_RAW_SCHEMA)
    medallion.split("orders_bronze")
    assert medallion.silver().count() == before[0] + 1
    assert medallion.quarantined().count() == before[1] + 1
    assert medallion.quarantined().where("order_id = 10000002").first().dq_reason == "invalid_amount"


def test_closed_and_running_windows(spark, folder, tmp_path):
    store = TableStore(spark, str(tmp_path))
    stream = gateway.parquet_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    args = (F.col("user_id"), "1 day", "10 minutes", store)
    closed = gateway.closed_windows(stream, *args, "closed")
    running = gateway.running_windows(stream, *args, "running")
    events = scan(spark, folder, "events")
    assert running.agg(F.sum("calls")).first()[0] == events.count()
    assert 0 < closed.count() <= running.count()
    assert closed.exceptAll(running).count() == 0


def test_payload_log_is_appended_once(spark, folder, tmp_path):
    store = TableStore(spark, str(tmp_path))
    stream = gateway.parquet_stream(spark, folder, "conversations")
    first = gateway.payload_log(stream, store).count()
    assert gateway.payload_log(stream, store).count() == first == scan(spark, folder, "conversations").count()


def test_old_files_and_unreadable_lines_are_kept(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    medallion = Medallion(spark, str(tmp_path / "medallion"))
    (landing / "new.json").write_text('{"order_id": 1, "total_amount": 2.5}\n\n')
    medallion.ingest(str(landing), "bronze", retail.ORDERS_RAW_SCHEMA)
    old = landing / "old.json"
    old.write_text(
        '{"order_id": 2, "coupon": {"a": [1]}, "user_id": "u7", "total_amount": 12.345}\n'
        "{broken\n"
        '{"order_id": 3, "order_id": 4, "status": null}\n'
        "[1, 2]\n"
    )
    past = time.time() - 400 * 86_400
    os.utime(old, (past, past))
    rows = medallion.ingest(str(landing), "bronze", retail.ORDERS_RAW_SCHEMA).collect()
    assert len(rows) == 5
    assert {r._unreadable for r in rows} == {None, "{broken", "[1, 2]"}
    rescued = {r.order_id: json.loads(r._rescued) if r._rescued else None for r in rows if not r._unreadable}
    assert rescued[1] is None and rescued[2] == [
        {"key": "coupon", "value": '{"a":[1]}'},
        {"key": "user_id", "value": "u7"},
        {"key": "total_amount", "value": "12.345"},
    ]
    # Of two fields of one name one is typed, the other kept as text.
    (number,) = {3, 4} & set(rescued)
    assert rescued[number] == [{"key": "order_id", "value": str(7 - number)}]


def test_streams_of_tables_of_several_files(spark, folder, tmp_path):
    for name in ("events", "conversations"):
        scan(spark, folder, name).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    store = TableStore(spark, str(tmp_path / "store"))
    stream = gateway.parquet_stream(spark, str(tmp_path), "conversations")
    assert gateway.payload_log(stream, store).count() == scan(spark, folder, "conversations").count()
    events = gateway.parquet_stream(spark, str(tmp_path), "events").withColumn("ts", F.col("ts").cast("timestamp"))
    running = gateway.running_windows(events, F.col("user_id"), "1 day", "10 minutes", store, "running")
    assert running.agg(F.sum("calls")).first()[0] == scan(spark, folder, "events").count()


def test_new_fields_become_columns_once_settled(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("size", T.LongType())])
    landing = tmp_path / "landing"
    landing.mkdir()
    medallion = Medallion(spark, str(tmp_path / "medallion"))

    def land(name, *rows):
        (landing / name).write_text("\n".join(json.dumps(r) for r in rows))
        return {r.id: r for r in medallion.ingest_growing(str(landing), "bronze", schema).collect()}

    land("a.json", {"id": 1, "size": 2})
    rows = land("b.json", {"id": 2, "n": 5, "x": 1.5, "ok": True, "day": "2024-02-29", "t": "é", "none": None, "size": "big"})
    assert "n" not in rows[2].asDict() and len(json.loads(rows[2]._rescued)) == 7
    fields = medallion.promote_fields("bronze", schema)
    assert fields == [
        ("day", "date", "day"), ("n", "bigint", "n"), ("ok", "boolean", "ok"),
        ("size_string", "string", "size"), ("t", "string", "t"), ("x", "double", "x"),
    ]
    rows = land("c.json", {"id": 3, "n": 7, "x": 2, "size": 4, "t": 9}, {"id": 4, "n": "many", "size": 1.5, "rare": 1})
    assert (rows[1].n, rows[1].size, rows[1].size_string) == (None, 2, None)
    assert (rows[2].n, rows[2].x, rows[2].ok, str(rows[2].day), rows[2].t, rows[2].size_string) == (5, 1.5, True, "2024-02-29", "é", "big")
    assert [e["key"] for e in json.loads(rows[2]._rescued)] == ["none"]
    assert (rows[3].n, rows[3].x, rows[3].t, rows[3].size, rows[3]._rescued) == (7, 2.0, "9", 4, None)
    # What does not fit a settled type stays, as does a field of too few rows.
    assert (rows[4].n, rows[4].size, rows[4].size_string) == (None, None, "1.5")
    assert {e["key"]: e["value"] for e in json.loads(rows[4]._rescued)} == {"n": "many", "rare": "1"}
    assert medallion.promote_fields("bronze", schema, share=0.5) == fields
    again = {r.id: r for r in medallion.grown("bronze", schema).collect()}
    assert again == rows and medallion.store.read("bronze").count() == 4


def test_lines_whose_entries_all_fit_are_not_searched(spark):
    """Entries are compared one by one only where their number differs from that of the fitting values."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("d", T.DecimalType(18, 2))])
    lines = {
        '{"a":1,"d":2.5}': (1, "2.50", None, None),
        '{"a":1}': (1, None, None, None),
        "{}": (None, None, None, None),
        '{"a":null,"d":1}': (None, "1.00", None, None),
        '{"a":1,"a":1}': (1, None, None, None),
        '{"a":1,"a":2}': (1, None, '[{"key":"a","value":"2"}]', None),
        '{"a":"x","d":1.234}': (None, None, '[{"key":"a","value":"x"},{"key":"d","value":"1.234"}]', None),
        '{"a":1,"b":2}': (1, None, '[{"key":"b","value":"2"}]', None),
        '{"a":1': (None, None, None, '{"a":1'),
    }
    for text, wanted in lines.items():
        row = typed_lines(spark.createDataFrame([(text,)], "value string"), schema).first()
        got = (row.a, None if row.d is None else str(row.d), row[RESCUED], row[UNREADABLE])
        assert got == wanted, text
    plan = typed_lines(spark.createDataFrame([(t,) for t in lines], "value string"), schema)
    tree = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(__sound" in tree
