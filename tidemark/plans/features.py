"""Per-customer features: orders, item affinity, engagement, occasions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import NO_DATE_DAYS, days_to_recurrence
from tidemark.functions.states import names_material
from tidemark.operators.grouped import aggregate_with_distinct


def as_of_date(orders: DataFrame) -> DataFrame:
    """One row: the latest order date, the day all features are measured from."""
    return orders.agg(F.max("order_date").alias("ref_date"))


def order_parts() -> dict[str, tuple[str, Column]]:
    """Parts of the order features that can be added up: how they merge, and the value of a row."""
    return {
        "monetary_total": ("sum", F.col("total_amount")),
        "amounts": ("sum", F.col("total_amount").isNotNull().cast("long")),
        "items": ("sum", F.col("item_count")),
        "item_counts": ("sum", F.col("item_count").isNotNull().cast("long")),
        "last_order_date": ("max", F.col("order_date")),
        "first_order_date": ("min", F.col("order_date")),
    }


def item_parts() -> dict[str, tuple[str, Column]]:
    """The same of the item features."""

    def named(word: str) -> Column:
        return F.coalesce(names_material(F.col("material"), word), F.lit(False)).cast("long")

    return {
        "total_items": ("sum", F.lit(1).cast("long")),
        "diamonds": ("sum", named("diamond")),
        "golds": ("sum", named("gold")),
    }


def order_features(orders: DataFrame) -> DataFrame:
    """Frequency, spend and date range per customer.

    The distinct count spreads a heavy customer's orders over tasks by (customer, order)
    before the final per-customer step, so one customer may own any share of the rows.
    """
    merges = {"sum": F.sum, "min": F.min, "max": F.max}
    summed = {name: merges[how](value) for name, (how, value) in order_parts().items()}
    return order_measures(aggregate_with_distinct(orders, "user_id", "order_id", "frequency", summed))


def order_measures(totals: DataFrame) -> DataFrame:
    """Order features from their parts per customer and ``frequency``."""
    return totals.select(
        "user_id",
        "frequency",
        "monetary_total",
        (F.col("monetary_total") / F.nullif("amounts", F.lit(0))).alias("aov"),
        (F.col("items") / F.nullif("item_counts", F.lit(0))).alias("avg_item_count"),
        "last_order_date",
        "first_order_date",
    )


def item_features(items: DataFrame) -> DataFrame:
    """Item count, category spread and material shares per customer."""
    parts = [F.sum(value).alias(name) for name, (_, value) in item_parts().items()]
    return item_measures(
        items.groupBy("user_id").agg(*parts, F.count_distinct("category").alias("distinct_categories"))
    )


def item_measures(totals: DataFrame) -> DataFrame:
    """Item features from their parts per customer and ``distinct_categories``."""
    return totals.select(
        "user_id",
        "total_items",
        "distinct_categories",
        (F.col("diamonds") / F.col("total_items")).alias("diamond_share"),
        (F.col("golds") / F.col("total_items")).alias("gold_share"),
    )


def engagement_features(events: DataFrame, count_name: str, value_name: str) -> DataFrame:
    """Number and value of cart or wishlist entries per customer."""
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias(count_name),
        F.coalesce(F.sum("price_inr"), F.lit(0)).alias(value_name),
    )


def occasion_features(users: DataFrame, ref: Column, birthday: bool = True, leap: str = "today") -> DataFrame:
    """Countdown to the next anniversary and birthday, and a milestone flag."""
    day = F.col("__ref")
    columns = {"days_to_anniversary": days_to_recurrence(F.col("anniversary_date"), day, leap)}
    if birthday:
        columns["days_to_birthday"] = days_to_recurrence(F.col("date_of_birth"), day, leap)
    columns["has_milestone"] = F.col("milestone_date").isNotNull().cast("int")
    dated = users.withColumn("__ref", ref)
    return dated.select("user_id", *[value.alias(name) for name, value in columns.items()])


def customer_features(
    orders: DataFrame,
    items: DataFrame,
    users: DataFrame,
    carts: DataFrame | None = None,
    wishlists: DataFrame | None = None,
    leap: str = "today",
) -> DataFrame:
    """One row per customer with orders.

    Without ``carts`` and ``wishlists`` the shorter pipeline form results (no engagement
    columns, no birthday). Each input is reduced to one row per customer before the
    joins, which therefore share one partitioning by customer; the as-of date enters as
    a scalar subquery, not as a join.
    """
    full = carts is not None and wishlists is not None
    ref = as_of_date(orders).scalar()
    engagement = []
    if full:
        engagement = [
            engagement_features(carts, "cart_adds", "cart_value"),
            engagement_features(wishlists, "wishlist_count", "wishlist_value"),
        ]
    return joined_features(order_features(orders), item_features(items), users, ref, engagement, leap)


def joined_features(
    orders: DataFrame,
    items: DataFrame,
    users: DataFrame,
    ref: Column,
    engagement: Sequence[DataFrame] = (),
    leap: str = "today",
) -> DataFrame:
    """Feature rows from order and item measures per customer, users, and the as-of date."""
    full = bool(engagement)
    joined = orders.join(items, "user_id", "left")
    for counts in engagement:
        joined = joined.join(counts, "user_id", "left")
    joined = joined.join(occasion_features(users, ref, full, leap), "user_id", "left")
    joined = joined.withColumn("feature_asof_date", ref)
    as_of = F.col("feature_asof_date")

    def filled(name: str, default: int = 0) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    columns = {
        "recency_days": F.datediff(as_of, F.col("last_order_date")),
        "tenure_days": F.datediff(as_of, F.col("first_order_date")),
        "frequency": F.col("frequency"),
        "monetary_total": F.col("monetary_total"),
        "aov": F.round("aov", 2).cast("decimal(20,2)"),
        "avg_item_count": F.round("avg_item_count", 3),
        "total_items": filled("total_items"),
        "distinct_categories": filled("distinct_categories"),
        "diamond_share": F.round(filled("diamond_share"), 4),
        "gold_share": F.round(filled("gold_share"), 4),
    }
    if full:
        engaged = ["cart_adds", "cart_value", "wishlist_count", "wishlist_value"]
        columns.update({name: filled(name) for name in engaged})
    columns["days_to_anniversary"] = filled("days_to_anniversary", NO_DATE_DAYS)
    if full:
        columns["days_to_birthday"] = filled("days_to_birthday", NO_DATE_DAYS)
    columns["has_milestone"] = filled("has_milestone")
    columns["feature_asof_date"] = as_of
    return joined.select("user_id", *[value.alias(name) for name, value in columns.items()])
