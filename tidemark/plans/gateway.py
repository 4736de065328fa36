"""Gateway policy as table jobs: text guard, usage counts, call limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text_guard import BANNED_KEYWORDS, guard_reasons

# Calls per minute.
USER_CALLS_PER_MINUTE = 60
ENDPOINT_CALLS_PER_MINUTE = 2000


def guard(
    df: DataFrame, text: str, keep: Sequence[str], keywords: Sequence[str] = BANNED_KEYWORDS
) -> DataFrame:
    """Every row's verdict; texts are read whole."""
    reasons = guard_reasons(F.col(text), keywords)
    return df.select(*keep, reasons.alias("reasons")).withColumn("blocked", F.col("reasons") != "")


def calls_per_window(events: DataFrame, key: Column, period: str, time: str = "ts") -> DataFrame:
    """Calls per key and tumbling window, combined before the shuffle; batch or stream."""
    return (
        events.groupBy(F.window(F.col(time), period).alias("period"), key.alias("caller"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .select("caller", F.col("period.start").alias("period_start"), "calls")
    )


def over_limit(events: DataFrame, key: Column, limit: int, period: str = "1 minute") -> DataFrame:
    """Callers and windows with more than ``limit`` calls."""
    return calls_per_window(events, key, period).where(F.col("calls") > limit)


#: A caller's time is cut into slices this many times as long as the span looked back on.
_SLICE_SPANS = 16


def calls_in_span(events: DataFrame, key: Column, seconds: int, time: str = "ts") -> DataFrame:
    """Caller, time and calls of every event: its caller's calls in the ``seconds`` up to it.

    Unlike counts per fixed window, this finds a burst across a window's edge. A caller's
    events are cut into time slices, each with the last ``seconds`` of the slice before,
    so a caller with most of all events is spread over many tasks, at the price of one
    event in ``_SLICE_SPANS`` counted twice on the way. Events without a time or a caller
    belong to no span and are left out.
    """
    span = seconds * 1_000_000
    slice_ = span * _SLICE_SPANS
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.select(key.alias("caller"), F.col(time).alias("called_at"), at.alias("__at"))
    rows = rows.where(F.col("caller").isNotNull() & F.col("__at").isNotNull())
    own = F.floor(F.col("__at") / slice_)
    # The next slice looks back on the last span of this one.
    late = F.floor((F.col("__at") + (span - 1)) / slice_)
    dealt = rows.withColumn("__own", own).withColumn("__slice", F.explode(F.array_distinct(F.array(own, late))))
    before = W.partitionBy("caller", "__slice").orderBy("__at").rangeBetween(-(span - 1), 0)
    counted = dealt.withColumn("calls", F.count(F.lit(1)).over(before))
    return counted.where(F.col("__slice") == F.col("__own")).select("caller", "called_at", "calls")


def callers_over_limit(events: DataFrame, key: Column, limit: int, seconds: int = 60) -> DataFrame:
    """Per caller: calls, those that came over the limit of any ``seconds``, and the most in such a span."""
    over = F.col("calls") > limit
    return (
        calls_in_span(events, key, seconds)
        .groupBy("caller")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if(over).alias("calls_over"),
            F.max("calls").alias("most_in_span"),
        )
    )
