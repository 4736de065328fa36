"""Serving table: projection, keyed upsert, checks, and evaluation history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import top_n
from tidemark.operators.upsert import upsert
from tidemark.sources.tables import TableStore

SERVING_COLUMNS = ["propensity_score", "segment", "decile"]

# Fixed values.
BATCH_ROWS = 1000


def serving_projection(scores: DataFrame) -> DataFrame:
    """The columns that are served, in the types of the serving table."""
    return scores.select(
        F.col("user_id").cast("int").alias("user_id"),
        F.col("propensity_score").cast("double").alias("propensity_score"),
        F.col("segment").cast("string").alias("segment"),
        F.col("decile").cast("int").alias("decile"),
    )


def sync_scores(existing: DataFrame, scores: DataFrame) -> DataFrame:
    """Serving table after the sync; changed and new rows carry the time of the sync."""
    return upsert(
        existing,
        serving_projection(scores),
        "user_id",
        SERVING_COLUMNS,
        stamp=("scored_at", F.current_timestamp()),
    )


def first_serving(store: TableStore, name: str, rows: DataFrame) -> DataFrame:
    """Write the first version of a serving table, in buckets by customer."""
    return store.replace_bucketed(name, rows, "user_id")


def sync_serving(store: TableStore, name: str, scores: DataFrame) -> DataFrame:
    """Write the next version of a serving table from its newest complete one and new scores.

    The old version lies in buckets by customer, so only the new scores are shuffled (not
    even these, if they lie in the same buckets), and each task of the join writes the
    buckets it holds. Readers keep the old version until the new one is complete; what a
    broken-off sync left behind is passed over, and the last two versions stay.
    """
    newest = store.read_bucketed(name, "user_id")
    return store.replace_bucketed(name, sync_scores(newest, scores), "user_id", deal=False)


def sync_check(serving: DataFrame) -> DataFrame:
    """Rows per segment with the total and mean score of the whole table."""
    whole = serving.agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"),
            F.round(F.avg("propensity_score"), 4).alias("avg"),
        )
    ).scalar()
    return (
        serving.groupBy("segment")
        .agg(F.count(F.lit(1)).alias("customers"))
        .select("segment", "customers", whole["rows"].alias("synced_rows"), whole["avg"].alias("avg_propensity"))
        .orderBy(F.col("customers").desc(), "segment")
    )


def write_jdbc_staging(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Executors write their own partitions to a staging table, in batches.

    The database then merges the staging table by key; see ``merge_statement``.
    """
    df.write.option("batchsize", BATCH_ROWS).jdbc(url, table, mode="overwrite", properties=properties)


def merge_statement(staging: str, target: str) -> str:
    """Upsert from the staging table, for databases with ``ON CONFLICT``."""
    columns = ", ".join(["user_id", *SERVING_COLUMNS])
    updates = ", ".join(f"{name} = excluded.{name}" for name in SERVING_COLUMNS)
    return (
        f"INSERT INTO {target} ({columns}) SELECT {columns} FROM {staging} "
        f"ON CONFLICT (user_id) DO UPDATE SET {updates}, scored_at = now()"
    )


def evaluation_row(summary: DataFrame) -> DataFrame:
    """The summary with the time of the evaluation, as appended to the history."""
    return summary.withColumn("evaluated_at", F.current_timestamp())


def latest_evaluations(history: DataFrame, n: int = 5) -> DataFrame:
    """The newest evaluations; of several at one time, those of more cases first."""
    return top_n(history, [F.col("evaluated_at").desc(), F.col("n").desc()], n)


def evaluation_summary(verdicts: DataFrame) -> DataFrame:
    """Number of judged cases and the share of each verdict."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("grounded").cast("double")).alias("groundedness"),
        F.avg(F.col("correct").cast("double")).alias("correctness"),
        F.avg(F.col("safe").cast("double")).alias("safety"),
    )
