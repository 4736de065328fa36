"""Scans and written tables on parquet."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import files

_VERSION = re.compile(r"version=(\d+)(?:\.buckets=(\d+))?")
#: Complete versions of a replaced table that stay, for readers still at work.
_KEPT = 2


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Batch scan of one parquet table; column pruning and filters reach the files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


class TableStore:
    """Parquet tables below one shared folder.

    A table is a folder of numbered versions. A version counts once its success marker is
    there, so a job that breaks off changes nothing for readers; the next writer takes a
    number above every folder it finds. Only names are listed, no data is read.

    ``replace`` writes a new version (its schema may change) and removes all but the last
    two, ``append`` adds rows to the newest version, or to the folder itself if there is
    none, and ``write_version`` keeps all versions.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _versions(self, name: str) -> dict[int, str]:
        """Folder of every version, complete or not, by number."""
        found = {}
        for folder in files.names_in(self.spark, self.path(name)):
            match = _VERSION.fullmatch(folder)
            if match:
                found[int(match[1])] = f"{self.path(name)}/{folder}"
        return found

    def _complete(self, name: str) -> dict[int, str]:
        found = self._versions(name)
        return {n: p for n, p in sorted(found.items()) if files.exists(self.spark, f"{p}/_SUCCESS")}

    def complete_versions(self, name: str) -> list[int]:
        return list(self._complete(name))

    def next_version(self, name: str) -> int:
        return max(self._versions(name), default=0) + 1

    def latest_version(self, name: str) -> int:
        """Number of the newest complete version; an error when there is none."""
        return max(self._complete(name))

    def has(self, name: str) -> bool:
        return bool(self._complete(name)) or files.exists(self.spark, f"{self.path(name)}/_SUCCESS")

    def _place(self, name: str) -> str:
        complete = self._complete(name)
        return complete[max(complete)] if complete else self.path(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._place(name))

    def _retire(self, name: str) -> None:
        kept = list(self._complete(name))[-_KEPT:]
        for number, path in self._versions(name).items():
            if number < min(kept):
                self.spark.sql(f"DROP TABLE IF EXISTS {self._catalog_name(name, path)}")
                files.remove(self.spark, path)

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path(name)}/version={self.next_version(name)}")
        self._retire(name)
        return self.read(name)

    def _catalog_name(self, name: str, path: str) -> str:
        return f"{name}_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"

    def replace_bucketed(self, name: str, df: DataFrame, key: str, deal: bool = True) -> DataFrame:
        """Replace a table whose rows are unique by ``key``, in buckets by that key.

        Joins of two such tables on the key need no shuffle, and a lookup of one key
        reads one bucket. One file per bucket is written. Not for fact tables: a frequent
        key would fill one bucket. ``deal=False`` leaves the rows where they are: right for
        the result of a join of such tables, whose tasks hold whole buckets.
        """
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{self.path(name)}/version={self.next_version(name)}.buckets={buckets}"
        table = self._catalog_name(name, path)
        (
            (df.repartition(buckets, key) if deal else df)
            .write.bucketBy(buckets, key)
            .sortBy(key)
            .option("path", path)
            .saveAsTable(table)
        )
        self._retire(name)
        return self.spark.table(table)

    def read_bucketed(self, name: str, key: str) -> DataFrame:
        """The newest version as a bucketed table, also in another application."""
        path = self._place(name)
        buckets = _VERSION.fullmatch(path.rsplit("/", 1)[1])[2]
        table = self._catalog_name(name, path)
        if not self.spark.catalog.tableExists(table):
            schema = self.spark.read.parquet(path).schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`)"
                f" INTO {buckets} BUCKETS LOCATION '{path}'"
            )
        return self.spark.table(table)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("append").parquet(self._place(name))
        return self.read(name)

    def write_version(self, name: str, version: int, df: DataFrame) -> DataFrame:
        path = f"{self.path(name)}/version={version}"
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.parquet(path)

    def read_version(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(self._complete(name)[version])
