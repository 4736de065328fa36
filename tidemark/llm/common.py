"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; keeps a batch of long texts small in Python's memory.
BATCH_ROWS = 1000

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and give every Python worker this package, once a session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(package.rglob("*.py")):
                archive.write(path, path.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(application)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def arrow_rows(
    batches: Iterator[pa.RecordBatch], chars: int = 1 << 20, rows: int = 256, text: str = "text"
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null as empty), about ``chars`` long."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        first, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= chars or i + 1 - first >= rows:
                yield batch.slice(first, i + 1 - first), texts[first : i + 1]
                first, held = i + 1, 0
        if first < len(texts):
            yield batch.slice(first), texts[first:]
    # A worker stays for later stages: what this one freed goes back to the system.
    pa.default_memory_pool().release_unused()


def held_out(doc_id: Column) -> Column:
    """True for rows that no model learns from: crc32 of the id as text, mod 3, is 1.

    A null id is held out, because nothing tells whether it may be learned from.
    """
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def row_key(df: DataFrame) -> Column:
    """Hash of a whole row that tells rows of one id apart; nulls count as values."""
    columns = [f"`{name}`" for name in df.columns]
    return F.xxhash64(*(F.col(c).isNull() for c in columns), *columns)


def row_struct(df: DataFrame) -> Column:
    """The whole row as one column, so that no name of it can clash with an added one."""
    return F.struct(*(F.col(f"`{name}`") for name in df.columns))
