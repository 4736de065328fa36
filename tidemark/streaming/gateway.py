"""Gateway streams: call counts per window and the payload log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.gateway import calls_per_window
from tidemark.sources.files import is_folder
from tidemark.sources.tables import TableStore
from tidemark.streaming.ingest import EVERY_FILE, append_stream


def parquet_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table, one file or a folder of files, as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**EVERY_FILE)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def closed_windows(
    events: DataFrame, key: Column, period: str, delay: str, store: TableStore, table: str
) -> DataFrame:
    """Append each window's calls once the watermark has passed its end."""
    counted = calls_per_window(events.withWatermark("ts", delay), key, period)
    append_stream(counted, store.path(table), store.path(f"_checkpoints/{table}")).awaitTermination()
    return store.read(table)


def running_windows(
    events: DataFrame, key: Column, period: str, delay: str, store: TableStore, table: str
) -> DataFrame:
    """Calls per window including windows still open.

    Each micro-batch stores the windows it changed under its own number; the count of a
    window only grows, so the largest stored one is the latest.
    """
    counted = calls_per_window(events.withWatermark("ts", delay), key, period)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store.path(table)}/batch={batch_id}")

    (
        counted.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", store.path(f"_checkpoints/{table}"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return (
        store.read(table).groupBy("caller", "period_start").agg(F.max("calls").alias("calls"))
    )


def payload_log(messages: DataFrame, store: TableStore, table: str = "payload_log") -> DataFrame:
    """Append every message to the log with its direction, size and time of logging."""
    direction = F.when(F.col("role") == "assistant", "response").otherwise("request")
    logged = messages.select(
        "conv_id",
        "turn",
        direction.alias("direction"),
        F.col("text").alias("payload"),
        F.length("text").alias("payload_chars"),
        F.current_timestamp().alias("logged_at"),
    )
    append_stream(logged, store.path(table), store.path(f"_checkpoints/{table}")).awaitTermination()
    return store.read(table)
