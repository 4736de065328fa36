"""KPI definitions: sales and propensity metric views, and the tables built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.states import engagement_state, names_material
from tidemark.operators.grouped import aggregate_with_distinct
from tidemark.operators.measures import MetricView, exact_mean


def sales_view(items: DataFrame) -> MetricView:
    """Sales measures over order items; the diamond mix counts item rows."""
    return MetricView(
        source=items,
        dimensions={
            "category": F.col("category"),
            "order_month": F.date_trunc("MONTH", F.col("order_date")).cast("date"),
        },
        measures={
            "revenue": F.sum("line_total"),
            "units_sold": F.sum("quantity"),
            "avg_unit_price": exact_mean(F.col("unit_price")),
            "diamond_mix": F.count_if(names_material(F.col("material"), "diamond")) / F.count(F.lit(1)),
        },
    )


def propensity_view(c360: DataFrame) -> MetricView:
    return MetricView(
        source=c360,
        dimensions={
            "segment": F.col("segment"),
            "engagement_state": engagement_state(F.col("recency_days")),
        },
        measures={
            "customers": F.count_distinct("user_id"),
            "avg_propensity": F.avg("propensity_score"),
            "avg_lifetime_value": exact_mean(F.col("monetary_total")),
        },
    )


SALES_MEASURES = ["revenue", "units_sold", "avg_unit_price", "diamond_mix"]
PROPENSITY_MEASURES = ["customers", "avg_propensity", "avg_lifetime_value"]


def category_performance_kpi(items: DataFrame) -> DataFrame:
    by_category = sales_view(items).query(SALES_MEASURES, by=["category"])
    return by_category.select(
        "category",
        F.col("units_sold").cast("bigint").alias("units"),
        F.round("revenue").cast("bigint").alias("revenue"),
        F.round("avg_unit_price").cast("bigint").alias("avg_unit_price"),
        F.col("diamond_mix").cast("decimal(10,3)").alias("diamond_mix"),
    )


def daily_sales_kpi(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders, revenue and units per day; both inputs are reduced to days before the join."""
    heads = aggregate_with_distinct(
        orders, "order_date", "order_id", "orders", {"revenue": F.sum("total_amount")}
    )
    units = items.groupBy("order_date").agg(F.sum("quantity").alias("units"))
    return heads.join(units, "order_date", "left").select(
        "order_date", "orders", "revenue", F.coalesce("units", F.lit(0)).alias("units")
    )


def customer_value_kpi(features: DataFrame) -> DataFrame:
    return features.select(
        "user_id",
        F.col("frequency").alias("orders"),
        F.col("monetary_total").alias("lifetime_value"),
        "aov",
    )


def segment_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.avg("propensity_score"), 4).alias("avg_score")
    )


def book_size(c360: DataFrame, points: float = 1.0) -> DataFrame:
    """Lifetime value of the whole book, value of a lift in points, customers per tier."""
    book = F.sum("monetary_total")
    tiers = [
        F.count_if(F.col("segment") == name).alias(f"{name.lower()}_customers")
        for name in ("High", "Medium", "Low")
    ]
    return c360.agg(
        F.count(F.lit(1)).alias("customers"),
        book.alias("ltv_book"),
        (book.cast("double") * points / 100).alias("value_of_lift"),
        *tiers,
    )
