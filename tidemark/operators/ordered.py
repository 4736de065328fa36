"""Global ranks and running totals without a single-task window.

The rows are range-partitioned on a total order and sorted inside each slice, so a run
of equal scores is still spread by the tie-break key. Each row's slice number and
position are stored with it in a written table: the slices can then be counted and read
again without the range sampling being able to change. Only one row per slice takes part
in the prefix sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import write_and_read

_PLACE = "__place"
_SLICE = "__slice"
_POSITION_BITS = 33  # layout of monotonically_increasing_id: slice number above, position below


def _in_order(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    sliced = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return write_and_read(sliced.withColumn(_PLACE, F.monotonically_increasing_id()), "ordered")


def _slice() -> Column:
    return F.shiftright(_PLACE, _POSITION_BITS).alias(_SLICE)


def _offsets(per_slice: DataFrame, names: Sequence[str]) -> DataFrame:
    """Totals of all earlier slices, and of all slices; one row per slice.

    The input has one row per shuffle partition, which bounds both the window and the
    broadcast of its result.
    """
    earlier = W.orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(_SLICE).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    columns = [F.col(_SLICE)]
    for name in names:
        columns.append(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"__before_{name}"))
        columns.append(F.sum(name).over(everything).alias(f"__all_{name}"))
    return F.broadcast(per_slice.select(*columns))


def global_rank(
    df: DataFrame, order: Sequence[Column], rank: str = "rank", total: str = "total"
) -> DataFrame:
    """Add the 1-based rank in ``order`` (which must be total) and the row count."""
    placed = _in_order(df, order)
    per_slice = placed.groupBy(_slice()).agg(F.count(F.lit(1)).alias("rows"))
    position = F.col(_PLACE).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        placed.withColumn(_SLICE, _slice())
        .join(_offsets(per_slice, ["rows"]), _SLICE)
        .select(
            *df.columns,
            (F.col("__before_rows") + position + 1).alias(rank),
            F.col("__all_rows").alias(total),
        )
    )


def rank_in_group(
    df: DataFrame,
    group: str,
    values: Sequence,
    order: Sequence[Column],
    rank: str = "rank",
    total: str = "total",
) -> DataFrame:
    """Rank inside each group, for a known short list of group ``values``.

    The group leads the global order, so a group that holds most of the rows is spread
    over many slices. The groups' sizes come back as one row, and the sizes of earlier
    groups are subtracted from the global rank. A value outside the list is an error.
    """
    unknown = F.raise_error(F.concat(F.lit(f"unexpected {group}: "), F.col(group).cast("string")))
    spot = F.coalesce(
        *[F.when(F.col(group) == value, F.lit(i)) for i, value in enumerate(values)], unknown.cast("int")
    )
    ranked = global_rank(df.withColumn("__spot", spot), [F.col("__spot"), *order], "__rank", "__total")
    names = [f"group{i}" for i in range(len(values))]
    counts = [F.count_if(F.col("__spot") == i).alias(name) for i, name in enumerate(names)]
    sizes = ranked.agg(F.struct(*counts)).scalar()
    earlier, size = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    before = F.lit(0).cast("bigint")
    for i, name in enumerate(names):
        here = F.col("__spot") == i
        earlier = F.when(here, before).otherwise(earlier)
        size = F.when(here, sizes[name]).otherwise(size)
        before = before + sizes[name]
    return ranked.select(*df.columns, (F.col("__rank") - earlier).alias(rank), size.alias(total))


def running_totals(df: DataFrame, order: Sequence[Column], amounts: Sequence[str]) -> DataFrame:
    """Add ``run_<amount>`` (inclusive prefix sum in ``order``) and ``all_<amount>``."""
    placed = _in_order(df, order).withColumn(_SLICE, _slice())
    per_slice = placed.groupBy(_SLICE).agg(*[F.sum(name).alias(name) for name in amounts])
    inside = W.partitionBy(_SLICE).orderBy(_PLACE).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = placed.select(
        "*", *[F.sum(name).over(inside).alias(f"__local_{name}") for name in amounts]
    )
    return local.join(_offsets(per_slice, amounts), _SLICE).select(
        *df.columns,
        *[(F.col(f"__before_{n}") + F.col(f"__local_{n}")).alias(f"run_{n}") for n in amounts],
        *[F.col(f"__all_{n}").alias(f"all_{n}") for n in amounts],
    )


def equal_frequency_bucket(rank: Column, total: Column, buckets: int = 10) -> Column:
    """Bucket 1..buckets by evenly spaced quantile edges over ranks 1..total.

    Rank r falls in bucket ceil((r-1)·buckets/(total-1)), and the first rank in bucket 1.
    The edges are integers over integers: a quotient is whole exactly when it should be,
    for any row count below 10^14.
    """
    span = F.greatest(total - 1, F.lit(1))
    return F.greatest(F.lit(1), F.ceil((rank - 1) * buckets / span)).cast("int")


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; rows beyond ``n`` are cut before the shuffle."""
    place = W.partitionBy(group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows overall; every task keeps at most ``n`` rows."""
    return df.orderBy(*order).limit(n)
