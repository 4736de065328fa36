"""Declarative row rules: clean split, quarantine with reasons, violation counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A row passes when ``passes`` is TRUE; ``reason`` names the failure."""

    name: str
    reason: str
    passes: Column

    def violated(self) -> Column:
        """TRUE or FALSE, never NULL: an unknown outcome counts as a violation."""
        return ~F.coalesce(self.passes, F.lit(False))


def order_rules() -> list[Rule]:
    """The five order rules, in the order their reasons are listed (fixed values)."""
    return [
        Rule("valid_amount", "invalid_amount", F.col("total_amount") > 0),
        Rule("has_user", "null_user", F.col("user_id").isNotNull()),
        Rule("has_order", "null_order", F.col("order_id").isNotNull()),
        Rule("has_status", "null_status", F.col("status").isNotNull()),
        Rule("has_date", "null_date", F.col("order_date").isNotNull()),
    ]


def readable_date_rule() -> Rule:
    """Extension: a date that is present but cannot be read as one."""
    readable = F.col("order_date").isNull() | F.col("order_date").try_cast("date").isNotNull()
    return Rule("readable_date", "bad_date", readable)


def _all_pass(rules: Sequence[Rule]) -> Column:
    return reduce(lambda left, right: left & right, [rule.passes for rule in rules])


def clean(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows for which every rule is TRUE."""
    return df.where(_all_pass(rules))


def verdict(rules: Sequence[Rule], mode: str = "complete") -> Column:
    """``clean``, ``quarantine`` or ``neither``; each row has one.

    ``complete`` sends to quarantine exactly the rows that are not clean. ``reference``
    negates the rules as written, so a row whose outcome is NULL is in neither table.
    """
    if mode not in ("complete", "reference"):
        raise ValueError(f"unknown quarantine mode: {mode}")
    passed = _all_pass(rules)
    failed = ~F.coalesce(passed, F.lit(False)) if mode == "complete" else ~passed
    return F.when(passed, "clean").when(failed, "quarantine").otherwise("neither")


def reason(rules: Sequence[Rule]) -> Column:
    """The reasons of all failed rules, joined."""
    return F.concat_ws("; ", *[F.when(rule.violated(), F.lit(rule.reason)) for rule in rules])


def quarantine(df: DataFrame, rules: Sequence[Rule], mode: str = "complete") -> DataFrame:
    """Rows whose verdict is quarantine, with ``dq_reason``."""
    return df.where(verdict(rules, mode) == "quarantine").withColumn("dq_reason", reason(rules))


def violation_counters(rules: Sequence[Rule]) -> list[Column]:
    """One counter per rule; usable in ``agg`` and in ``observe``."""
    return [F.count_if(rule.violated()).alias(rule.name) for rule in rules]


def violation_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule with its number of violations, from one pass over ``df``."""
    names = [rule.name for rule in rules]
    return (
        df.agg(*violation_counters(rules))
        .unpivot([], names, "rule", "violations")
    )


def silver_orders(df: DataFrame) -> DataFrame:
    """Typed projection of valid orders; an unreadable date becomes NULL, never an error."""
    return df.select(
        "order_id",
        "user_id",
        "total_amount",
        "status",
        F.col("order_date").try_cast("date").alias("order_date"),
        "item_count",
        F.col("created_at").try_cast("date").alias("created_at"),
    )
