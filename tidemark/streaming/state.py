"""Aggregates per key that grow batch by batch, without reading history again.

A state holds one row per key: sums, counts, extremes, and numbers of distinct values.
Rows are dealt by a hash of the key into buckets, each a folder. Merging a batch
aggregates the batch alone, reads the buckets of its keys, and writes new versions of just
these; keys of other buckets are neither read nor written. For a number of distinct
values, the values seen lie beside the state in the same buckets, one row each, so a key
with any share of the rows is spread over files and tasks.

A manifest names the version of every bucket. It is replaced as a whole and last, so a
merge that breaks off changes nothing, and its repetition writes over what it left. A
batch whose number is not above the manifest's is a repetition, and is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import write_and_read
from tidemark.sources import files
from tidemark.sources.tables import TableStore

#: A bucket is what a merge reads and writes at least; take more where there are more keys.
BUCKETS = 32

_MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


class KeyedState:
    """``measures``: name -> ("sum", "min" or "max", value of a row); ``distinct``: name -> column.

    Rows with a NULL key belong to no state. A NULL value counts as no value.
    """

    def __init__(
        self,
        store: TableStore,
        name: str,
        key: str,
        measures: dict[str, tuple[str, Column]],
        distinct: dict[str, str] | None = None,
        buckets: int = BUCKETS,
    ):
        self.spark = store.spark
        self.store, self.name, self.key = store, name, key
        self.measures, self.distinct, self.buckets = measures, distinct or {}, buckets

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row per key of rows that each hold a part; every value keeps its type."""
        whole = [
            _MERGES[how](name).cast(rows.schema[name].dataType).alias(name)
            for name, (how, _) in self.measures.items()
        ]
        counts = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in self.distinct]
        return rows.groupBy("bucket", self.key).agg(*whole, *counts)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int").alias("bucket")

    def manifest(self) -> dict[int, int]:
        """Version of each bucket that holds keys; -1 stands for the last batch merged."""
        name = f"{self.name}_manifest"
        if not self.store.has(name):
            return {}
        return {r.bucket: r.version for r in self.store.read(name).collect()}

    def _rows_of(self, manifest: dict[int, int], buckets: set[int]) -> DataFrame | None:
        """The state of some buckets, by the version that the manifest names."""
        root = self.store.path(f"{self.name}_rows")
        paths = [f"{root}/version={v}/bucket={b}" for b, v in sorted(manifest.items()) if b in buckets]
        if not paths:
            return None
        return self.spark.read.option("basePath", root).parquet(*paths).drop("version")

    def _new_values(self, batch: DataFrame, name: str, last: int, number: int, buckets: set[int]) -> DataFrame:
        """(bucket, key, value) of the values that no earlier batch brought, kept for later ones."""
        column = self.distinct[name]
        pairs = batch.select("bucket", self.key, F.col(column).alias("value")).where("value IS NOT NULL").distinct()
        root = self.store.path(f"{self.name}_{name}")
        seen = [
            f"{root}/{part}/bucket={b}"
            for part in files.names_in(self.spark, root)
            if part.startswith("batch=") and int(part.removeprefix("batch=")) <= last
            for b in sorted(buckets)
        ]
        seen = [path for path in seen if files.exists(self.spark, path)]
        if seen:
            old = self.spark.read.option("basePath", root).parquet(*seen).select(self.key, "value")
            pairs = pairs.join(old, [self.key, "value"], "left_anti")
        path = f"{root}/batch={number}"
        pairs.write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(pairs.schema).parquet(path)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Merge the rows of batch ``number``; numbers ascend."""
        manifest = self.manifest()
        last = manifest.pop(-1, -1)
        if number <= last:
            return
        keyed = batch.where(F.col(self.key).isNotNull())
        kinds = keyed.agg(*[_MERGES[how](value).alias(name) for name, (how, value) in self.measures.items()]).schema
        own = [value.cast(kinds[name].dataType).alias(name) for name, (_, value) in self.measures.items()]
        wanted = [self.key, *dict.fromkeys(self.distinct.values())]
        rows = keyed.select(self._bucket(), *wanted, F.struct(*own).alias("measures"))
        rows = write_and_read(rows, f"{self.name}-batch")
        buckets = {r.bucket for r in rows.select("bucket").distinct().collect()}
        measured = rows.select("bucket", self.key, "measures.*", *[F.lit(0).cast("long").alias(n) for n in self.distinct])
        parts = [self._merged(measured)]
        for name in self.distinct:
            counted = self._new_values(rows, name, last, number, buckets).groupBy("bucket", self.key)
            parts.append(counted.agg(F.count(F.lit(1)).alias(name)))
        delta = parts[0]
        for part in parts[1:]:
            delta = delta.unionByName(part, allowMissingColumns=True)
        old = self._rows_of(manifest, buckets)
        if old is not None:
            delta = delta.unionByName(old, allowMissingColumns=True)
        path = f"{self.store.path(f'{self.name}_rows')}/version={number}"
        # A large bucket is cut into files of the advisory size, small ones are not.
        self._merged(delta).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        manifest |= {b: number for b in buckets} | {-1: number}
        kept = self.spark.createDataFrame(sorted(manifest.items()), "bucket int, version long")
        self.store.replace(f"{self.name}_manifest", kept.coalesce(1))
        self._retire()

    def _retire(self) -> None:
        """Remove versions of buckets that none of the manifests still kept names."""
        name = f"{self.name}_manifest"
        kept = [self.store.read_version(name, v) for v in self.store.complete_versions(name)]
        named = {(r.version, r.bucket) for table in kept for r in table.collect()}
        path = self.store.path(f"{self.name}_rows")
        for part in files.names_in(self.spark, path):
            if not part.startswith("version="):
                continue
            for folder in files.names_in(self.spark, f"{path}/{part}"):
                if folder.startswith("bucket="):
                    place = int(part.removeprefix("version=")), int(folder.removeprefix("bucket="))
                    if place not in named:
                        files.remove(self.spark, f"{path}/{part}/{folder}")

    def read(self) -> DataFrame:
        """One row per key: key, measures and numbers of distinct values."""
        manifest = self.manifest()
        manifest.pop(-1, None)
        return self._rows_of(manifest, set(manifest)).drop("bucket")
