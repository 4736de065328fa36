"""Aggregation that mixes sums with one distinct count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate_with_distinct(
    df: DataFrame, key: str, distinct: str, name: str, aggregates: dict[str, Column]
) -> DataFrame:
    """Per ``key``: the number of distinct values as ``name``, and ``aggregates``.

    In one aggregation every sum would travel with every (key, value) pair. Here the
    pairs are made distinct alone, and the sums are combined per key before their own
    shuffle. Both results are partitioned by the key, so putting them together moves
    nothing. A NULL key is a group like any other.
    """
    counted = (
        df.select(key, distinct).distinct().groupBy(key).agg(F.count(distinct).alias(name))
    )
    summed = df.groupBy(key).agg(*[value.alias(label) for label, value in aggregates.items()])
    both = summed.unionByName(counted, allowMissingColumns=True)
    # Each column is filled in one of the two rows of a key.
    return both.groupBy(key).agg(*[F.max(label).alias(label) for label in [name, *aggregates]])
