"""Incremental JSON ingest, stream-to-stream quality split, refresh of the gold table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DataType, DecimalType, StructType

from tidemark.operators import quality
from tidemark.plans.features import (
    customer_features,
    item_measures,
    item_parts,
    joined_features,
    order_measures,
    order_parts,
)
from tidemark.sources.tables import TableStore
from tidemark.streaming.state import KeyedState


#: Files of any age are taken, in micro-batches of bounded size.
EVERY_FILE = {"maxFilesPerTrigger": "1000", "maxFileAge": "36500d"}

RESCUED, UNREADABLE = "_rescued", "_unreadable"


def typed_lines(lines: DataFrame, schema: StructType) -> DataFrame:
    """JSON lines (column ``value``) as typed columns that lose nothing.

    Fields that the schema doesn't name, and values that don't fit their type, are kept
    as a JSON list of keys and values (as text) in ``_rescued``; a line that is no JSON object in
    ``_unreadable``, with NULL in all other columns. Blank lines are no records.
    """
    fields = F.from_json("value", "map<string,string>")
    rows = lines.where(F.trim("value") != "").withColumn("__fields", fields)
    typed, sound, held = {}, [], F.lit(0)
    for field in schema.fields:
        raw = F.col("__fields").getItem(field.name)
        value = raw.try_cast(field.dataType)
        if isinstance(field.dataType, DecimalType):
            value = F.when(value == raw.try_cast("decimal(38,18)"), value)
        typed[field.name] = value
        fits = F.col(field.name).isNotNull()
        sound.append(F.when(fits | raw.isNull(), F.lit(field.name)))
        held = held + fits.cast("int")
    # As many entries as values that fit: nothing is left, and the entries need no look.
    whole = F.coalesce(F.size("__fields") == held, F.lit(False))
    rows = rows.withColumns(typed).withColumn("__sound", F.when(~whole, F.array_compact(F.array(*sound))))
    # An entry stays behind if its name isn't among the sound fields, or if it is a
    # second one of its name.
    left = F.filter(
        F.map_entries("__fields"),
        lambda e: ~F.array_contains("__sound", e["key"])
        | ~F.element_at("__fields", e["key"]).eqNullSafe(e["value"]),
    )
    return rows.withColumns(
        {
            RESCUED: F.when(F.col("__sound").isNotNull() & (F.size(left) > 0), F.to_json(left)),
            UNREADABLE: F.when(F.col("__fields").isNull(), F.col("value")),
        }
    ).drop("value", "__fields", "__sound")


def json_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """New JSON-lines files of a landing folder, with their path and the time of ingest.

    The schema is given, not inferred; a file is read once, whatever number of runs, and
    however old it is when it arrives.
    """
    lines = spark.readStream.options(**EVERY_FILE).text(folder)
    named = lines.select(
        "value",
        F.col("_metadata.file_path").alias("_source_file"),
        F.current_timestamp().alias("_bronze_ingested_at"),
    )
    names = [*schema.fieldNames(), RESCUED, UNREADABLE, "_source_file", "_bronze_ingested_at"]
    return typed_lines(named, schema).select(*names)


def inferred_schema(spark: SparkSession, folder: str, sample: float = 1.0) -> StructType:
    """Schema guessed from the records landed so far, for first contact.

    All records are read unless a share is asked for; a field that occurs only in the
    others is then missing, though not lost (see ``typed_lines``). A table's ingest
    should keep the first guess.
    """
    return spark.read.option("samplingRatio", sample).json(folder).schema


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a parquet table, exactly once, and stop."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class Medallion:
    """Landing folders → bronze tables → silver and quarantine → gold.

    Every step may be run again at any time: streams continue from their checkpoints and
    each micro-batch writes to a folder of its own number, so a repeated batch replaces
    itself.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = TableStore(spark, root)

    def ingest(self, landing: str, table: str, schema: StructType) -> DataFrame:
        """Append new JSON files of ``landing`` to the bronze ``table``."""
        stream = json_stream(self.spark, landing, schema)
        path = self.store.path(table)
        append_stream(stream, path, self.store.path(f"_checkpoints/{table}")).awaitTermination()
        return self.store.read(table)

    def _grown_fields(self, table: str) -> list[tuple[str, str, str]]:
        """Columns promoted so far: (name, type, field of the landed records)."""
        name = f"{table}_schema"
        if not self.store.has(name):
            return []
        return [tuple(r) for r in self.store.read(name).orderBy("place").drop("place").collect()]

    def ingest_growing(self, landing: str, table: str, schema: StructType) -> DataFrame:
        """As ``ingest``; fields that ``promote_fields`` has settled arrive as columns."""
        whole = StructType(list(schema.fields))
        for name, kind, field in self._grown_fields(table):
            if name == field:
                whole = whole.add(name, DataType.fromDDL(kind))
        self.ingest(landing, table, whole)
        return self.grown(table, schema)

    def grown(self, table: str, schema: StructType) -> DataFrame:
        """The bronze table with all promoted columns, for rows landed before as well.

        ``schema`` is the one the table began with. Rows of older files, and values that
        did not fit, take a promoted column from ``_rescued``, which keeps the rest.
        """
        fields = self._grown_fields(table)
        stored = StructType(list(schema.fields))
        for name, kind, field in fields:
            if name == field:
                stored = stored.add(name, DataType.fromDDL(kind))
        for name in (RESCUED, UNREADABLE, "_source_file"):
            stored = stored.add(name, "string")
        stored = stored.add("_bronze_ingested_at", "timestamp")
        rows = self.spark.read.schema(stored).parquet(self.store.path(table))
        entries = F.from_json(RESCUED, "array<struct<key:string,value:string>>")
        rows = rows.withColumn("__left", entries)

        def held(field: str) -> Column:
            return F.get(F.filter("__left", lambda e: e["key"] == field), F.lit(0))["value"]

        promoted, settled = {}, []
        for name, kind, field in fields:
            value = held(field).try_cast(kind)
            promoted[name] = F.coalesce(F.col(name), value) if name == field else value
            settled.append(F.when(value.isNotNull(), F.lit(field)))
        if not fields:
            return rows.drop("__left")
        known = F.array_compact(F.array(*settled))
        rest = F.filter("__left", lambda e: ~F.array_contains("__known", e["key"]))
        grown = rows.withColumns({"__known": known, **promoted})
        return grown.withColumn(RESCUED, F.when(F.size(rest) > 0, F.to_json(rest))).drop("__left", "__known")

    def promote_fields(self, table: str, schema: StructType, share: float = 0.01) -> list[tuple[str, str, str]]:
        """Make columns of the rescued fields that a ``share`` of all rows have.

        The type is the first of whole number, number, truth value, date and text that
        fits every value so far. A field of the schema whose values came in another type
        becomes a column of its own, named for field and type; the old one stays as it
        is. What arrives later and does not fit stays in ``_rescued``.
        """
        rows = self.grown(table, schema)
        kinds = ["bigint", "double", "boolean", "date"]
        total = rows.agg(F.count(F.lit(1))).scalar()
        entries = F.explode(F.from_json(RESCUED, "array<struct<key:string,value:string>>"))
        fits = [F.count(F.col("e.value").try_cast(kind)).alias(kind) for kind in kinds]
        # A share of the rows bounds the number of fields that can have it.
        found = (
            rows.select(entries.alias("e"))
            .groupBy("e.key")
            .agg(F.count("e.value").alias("n"), *fits)
            .where((F.col("n") > 0) & (F.col("n") >= total * share))
            .orderBy("key")
            .collect()
        )
        fields = self._grown_fields(table)
        taken = {name for name, _, _ in fields} | set(schema.fieldNames())
        for row in found:
            kind = next((k for k in kinds if row[k] == row.n), "string")
            name = row.key if row.key not in taken else f"{row.key}_{kind}"
            if name not in taken:
                taken.add(name)
                fields.append((name, kind, row.key))
        numbered = [(i, *field) for i, field in enumerate(fields)]
        if numbered:
            table_of = self.spark.createDataFrame(numbered, "place int, name string, kind string, field string")
            self.store.replace(f"{table}_schema", table_of.coalesce(1))
        return fields

    def stream_of(self, table: str) -> DataFrame:
        """The bronze table as a stream of its new rows."""
        schema = self.store.read(table).schema
        return self.spark.readStream.schema(schema).options(**EVERY_FILE).parquet(self.store.path(table))

    def split(self, bronze: str, rules: Sequence[quality.Rule] | None = None, mode: str = "complete") -> None:
        """Tell clean from quarantined among new bronze rows, and count violations per rule.

        Each micro-batch is read once and written once, with its verdict as a folder, so
        silver and quarantine read only their own files; the counts are observed on the way.
        """
        rules = list(rules or quality.order_rules())

        def write(batch: DataFrame, batch_id: int) -> None:
            seen = Observation(f"violations-{batch_id}")
            part = f"batch={batch_id}"
            judged = batch.observe(seen, *quality.violation_counters(rules)).withColumns(
                {"dq_reason": quality.reason(rules), "verdict": quality.verdict(rules, mode)}
            )
            judged.write.mode("overwrite").partitionBy("verdict").parquet(
                f"{self.store.path('orders_judged')}/{part}"
            )
            counts = [(name, int(number)) for name, number in seen.get.items()]
            batch.sparkSession.createDataFrame(counts, "rule string, violations bigint").coalesce(
                1
            ).write.mode("overwrite").parquet(f"{self.store.path('orders_violations')}/{part}")

        (
            self.stream_of(bronze)
            .writeStream.foreachBatch(write)
            .option("checkpointLocation", self.store.path(f"_checkpoints/{bronze}_split"))
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )

    def _judged(self, verdict: str) -> DataFrame:
        judged = self.store.read("orders_judged")
        return judged.where(F.col("verdict") == verdict).drop("batch", "verdict")

    def silver(self) -> DataFrame:
        return quality.silver_orders(self._judged("clean"))

    def quarantined(self) -> DataFrame:
        return self._judged("quarantine")

    def violations(self) -> DataFrame:
        """Violations per rule over all batches so far."""
        return (
            self.store.read("orders_violations")
            .groupBy("rule")
            .agg(F.sum("violations").alias("violations"))
        )

    def refresh_gold(self, items: str, users: str) -> DataFrame:
        """Recompute the gold features from silver orders and bronze items and users."""
        gold = customer_features(self.silver(), self.store.read(items), self.store.read(users))
        return self.store.replace("customer_features_gold", gold)

    def states(self) -> dict[str, KeyedState]:
        """What the gold features need of orders, items and users, per customer."""
        dates = ["anniversary_date", "date_of_birth", "milestone_date"]
        newest = F.struct("_bronze_ingested_at", *dates)
        return {
            "orders": KeyedState(self.store, "state_orders", "user_id", order_parts(), {"frequency": "order_id"}),
            "items": KeyedState(
                self.store, "state_items", "user_id", item_parts(), {"distinct_categories": "category"}
            ),
            "users": KeyedState(self.store, "state_users", "user_id", {"newest": ("max", newest)}),
        }

    def _merge_new(self, table: str, state: KeyedState, shape: Callable[[DataFrame], DataFrame]) -> None:
        """Merge the rows that reached a bronze table since the last call."""
        (
            self.stream_of(table)
            .writeStream.foreachBatch(lambda batch, number: state.merge(shape(batch), number))
            .option("checkpointLocation", self.store.path(f"_checkpoints/{table}_{state.name}"))
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )

    def merge_gold(
        self,
        orders: str,
        items: str,
        users: str,
        rules: Sequence[quality.Rule] | None = None,
        mode: str = "complete",
    ) -> None:
        """Bring the customers' states up to date with new bronze rows, reading only these.

        Late rows are rows like others. A customer's newest user record counts.
        """
        rules = list(rules or quality.order_rules())
        states = self.states()
        silver = lambda batch: quality.silver_orders(quality.clean(batch, rules))
        self._merge_new(orders, states["orders"], silver)
        self._merge_new(items, states["items"], lambda batch: batch)
        self._merge_new(users, states["users"], lambda batch: batch)

    def merged_gold(self) -> DataFrame:
        """The gold features from the states: one row per customer is read, no history.

        They are measured from the latest order date so far, which moves with every batch
        for all customers, so they are derived when read.
        """
        states = self.states()
        orders = states["orders"].read()
        ref = orders.agg(F.max("last_order_date")).scalar()
        users = states["users"].read().select("user_id", "newest.*")
        return joined_features(order_measures(orders), item_measures(states["items"].read()), users, ref)
