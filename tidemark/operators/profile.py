"""Table profile: one row per column, plus one row for the table."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_ROW = ":table"

_CELLS = {
    "row_count": "bigint",
    "null_count": "bigint",
    "distinct_count": "bigint",
    "min_number": "double",
    "max_number": "double",
    "min_text": "string",
    "max_text": "string",
    "mean": "double",
    "stddev": "double",
}


def _summary(field: T.StructField, unique: bool) -> Column:
    """Counts, range and moments of one column, in the cells all columns share."""
    column = F.col(f"`{field.name}`")
    cells = {
        "row_count": F.count(F.lit(1)),
        "null_count": F.count_if(column.isNull()),
        "distinct_count": F.count(column) if unique else F.count_distinct(column),
    }
    if isinstance(field.dataType, T.NumericType):
        number = column.cast("double")
        cells["min_number"], cells["max_number"] = F.min(number), F.max(number)
        cells["mean"], cells["stddev"] = F.avg(number), F.stddev_samp(number)
    else:
        cells["min_text"], cells["max_text"] = F.min(column), F.max(column)
    return _cells(cells).alias(field.name)


def _cells(known: dict[str, Column]) -> Column:
    empty = F.lit(None)
    return F.struct(*[known.get(name, empty).cast(kind).alias(name) for name, kind in _CELLS.items()])


def profile(df: DataFrame, unique: Collection[str] = ()) -> DataFrame:
    """Rows, NULLs, distinct values, range, mean and deviation of every column.

    One aggregation over one scan measures all columns. For the distinct counts each row
    is repeated by column, in the column's own type, and equal values meet in each task
    before they are shuffled. The values of a ``unique`` column are only counted.
    """
    table = _cells({"row_count": F.count(F.lit(1)), "null_count": F.lit(0)}).alias(TABLE_ROW)
    names = [*df.columns, TABLE_ROW]
    measured = df.agg(*[_summary(field, field.name in unique) for field in df.schema.fields], table)
    summary = measured.unpivot([], [F.col(f"`{name}`") for name in names], "column_name", "cells")
    # The columns' counts are never NULL, which makes the table's a 0 among them.
    counted = F.when(F.col("column_name") != TABLE_ROW, F.col("cells.distinct_count")).alias("distinct_count")
    return summary.select("column_name", *[f"cells.{c}" for c in _CELLS if c != "distinct_count"], counted)
