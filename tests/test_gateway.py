import random
import re
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from tidemark.plans import gateway

CASES = {
    "write to ab@mail.example now": "email",
    "a@b.co": "email",
    "not@address": "",
    "@handle.com": "",
    "pay with 4111 1111 1111 1111 today": "card_number",
    "pay with 4111-1111-1111-1111": "card_number",
    "4111111111111111": "card_number",
    "41111111111111112": "",
    "x41111111111111112222": "",
    "id 1234 5678 9012 end": "national_id",
    "id 1234 5678 90123 end": "",
    "1234 5678 9012": "national_id",
    " 1234 5678 9012 - 5": "national_id",
    "7 1234 5678 9012": "",
    "1234 5678 9012 7": "",
    "id 123456789012 end": "",
    "the PassWord is hidden": "keyword:password",
    "Credit Card Number: none": "keyword:credit card number",
    "ab@c.de and password": "email; keyword:password",
    "": "",
    "nothing here": "",
}


@pytest.mark.parametrize("text, reasons", list(CASES.items()))
def test_guard(spark, text, reasons):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    row = gateway.guard(df, "text", ["id"]).first()
    assert (row.reasons, row.blocked) == (reasons, reasons != "")


def test_guard_reads_the_whole_text(spark):
    long = "word " * 50_000 + "ab@mail.example"
    df = spark.createDataFrame([(1, long)], "id int, text string")
    assert gateway.guard(df, "text", ["id"]).first().blocked


def test_guard_equals_plain_patterns_on_all_documents(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r.reasons for r in gateway.guard(documents, "text", ["doc_id"]).collect()}
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
        "card_number": r"(^|[^0-9])[0-9]{4}([ -]?[0-9]{4}){3}([^0-9]|$)",
        "national_id": r"(?<![0-9])(?<![0-9][ -])[0-9]{4} [0-9]{4} [0-9]{4}(?![ -]?[0-9])",
    }
    for row in documents.collect():
        expected = [n for n, p in patterns.items() if re.search(p, row.text)]
        expected += [f"keyword:{w}" for w in gateway.BANNED_KEYWORDS if w in row.text.lower()]
        assert got[row.doc_id] == "; ".join(expected)


def test_over_limit(spark):
    rows = [("2024-01-01 00:00:%02d" % i, 1) for i in range(4)] + [("2024-01-01 00:01:00", 1)]
    events = spark.createDataFrame(rows, "ts string, user int").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "user")
    from pyspark.sql import functions as F

    over = gateway.over_limit(events, F.col("user"), 3).collect()
    assert [(r.caller, r.calls) for r in over] == [(1, 4)]
    assert gateway.over_limit(events, F.col("user"), 4).count() == 0


def test_rolling_limit(spark):
    """Bursts across edges of minutes and slices, equal times, and one caller with most of all calls."""
    rng = random.Random(4)
    times = [("a", 59_000 + i * 20) for i in range(100)]  # 100 calls around the turn of a minute
    times += [("hot", rng.randrange(0, 40 * 60_000)) for _ in range(4000)]
    times += [("same", 16 * 60_000)] * 5 + [("same", 16 * 60_000 - 60_000), ("same", 16 * 60_000 - 59_999)]
    rows = spark.createDataFrame([(c, t) for c, t in times] + [(None, 5), ("a", None)], "who string, ms long")
    events = rows.select("who", F.timestamp_millis("ms").alias("ts"))
    found = gateway.calls_in_span(events, F.col("who"), 60)
    got = sorted((r.caller, r.ms, r.calls) for r in found.withColumn("ms", F.unix_millis("called_at")).collect())
    by_caller = {c: sorted(t for d, t in times if d == c) for c in ("a", "hot", "same")}
    wanted = sorted((c, t, bisect_right(by_caller[c], t) - bisect_right(by_caller[c], t - 60_000)) for c, t in times)
    assert got == wanted
    limits = {r.caller: r for r in gateway.callers_over_limit(events, F.col("who"), 60).collect()}
    assert limits["a"].calls_over == 40 and limits["a"].most_in_span == 100 and limits["same"].calls_over == 0
    fixed = gateway.over_limit(events.where("who = 'a'"), F.col("who"), 60)
    assert fixed.count() == 0  # what fixed windows do not see


def test_rolling_limit_spreads_a_hot_caller(spark):
    who = F.when(F.col("id") >= 0, "hot")
    events = spark.range(20_000).select(who.alias("who"), F.timestamp_millis(F.col("id") * 1000).alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = gateway.calls_in_span(events, F.col("who"), 60).select(F.spark_partition_id().alias("task"))
        tasks = [r["count"] for r in rows.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 20_000 and max(tasks) < 10_000
