"""Join of many rows to a table with unique keys, with frequent keys set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import write_and_read

HOT_SHARE = 0.001


def frequent_keys(rows: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of all rows: fewer than 1/share keys, always."""
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return counted.where(F.col(key).isNotNull() & (F.col("__n") > total * share)).select(key)


def lookup_join(rows: DataFrame, table: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Left join of ``rows`` to ``table``, whose ``key`` is unique.

    Rows of frequent keys, and rows without a key, stay where they are and meet a
    broadcast of the few table rows they need, at most 1/share of them. All other rows
    are joined by shuffling both sides, and no such key holds more than ``share`` of the
    rows. The broadcast is bounded by arithmetic, whatever the size of the table.
    """
    hot = write_and_read(frequent_keys(rows, key, share), "hot-keys")
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    apart = F.col("__hot").isNotNull() | F.col(key).isNull()
    few = table.join(F.broadcast(hot), key, "left_semi")
    hot_rows = marked.where(apart).drop("__hot").join(F.broadcast(few), key, "left")
    cold_rows = marked.where(~apart).drop("__hot").join(table, key, "left")
    return hot_rows.unionByName(cold_rows)
