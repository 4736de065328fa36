"""The business questions, each as one query over the KPI views."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.states import names_material
from tidemark.operators.ordered import top_n
from tidemark.plans.features import as_of_date
from tidemark.plans.kpis import propensity_view, sales_view


def revenue_by_category(items: DataFrame, this_year: bool = False) -> DataFrame:
    """Revenue and diamond mix per category, ranked by mix; optionally the as-of year only.

    The start of the year is one value compared with the bare column, so the files' date
    ranges are used to skip older data.
    """
    where = F.col("category").isNotNull()
    if this_year:
        start = items.agg(F.trunc(F.max("order_date"), "YEAR").alias("start")).scalar()
        where = where & (F.col("order_date") >= start)
    per_category = sales_view(items).query(["revenue", "diamond_mix"], by=["category"], where=where)
    # One row per category, so the unpartitioned window is small.
    rank = F.rank().over(W.orderBy(F.col("diamond_mix").desc()))
    return per_category.withColumn("diamond_mix_rank", rank).orderBy(
        F.col("revenue").desc(), "category"
    )


def segment_comparison(c360: DataFrame, segments: Collection[str] = ("High", "Low")) -> DataFrame:
    return (
        propensity_view(c360)
        .query(["customers", "avg_lifetime_value"], by=["segment"], where=F.col("segment").isin(list(segments)))
        .orderBy("segment")
    )


def monthly_revenue(items: DataFrame, category: str, months: int = 6) -> DataFrame:
    """Revenue per month of one category over the last months up to the as-of month."""
    last = F.trunc(F.max("order_date"), "MONTH")
    start = items.agg(F.add_months(last, -(months - 1)).alias("start")).scalar()
    recent = (F.col("category") == category) & (F.col("order_date") >= start)
    return sales_view(items).query(["revenue"], by=["order_month"], where=recent).orderBy("order_month")


def most_high_state(c360: DataFrame) -> DataFrame:
    """The engagement state with the most High customers."""
    counts = propensity_view(c360).query(
        ["customers"], by=["engagement_state"], where=F.col("segment") == "High"
    )
    return top_n(counts, [F.col("customers").desc(), F.col("engagement_state")], 1)


def order_value_by_diamond_buyer(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Average order value of customers with and without a diamond item.

    Orders are summed per customer first, so the join has one row per customer and side.
    """
    buyers = items.groupBy("user_id").agg(
        F.bool_or(names_material(F.col("material"), "diamond")).alias("flag")
    )
    spent = orders.groupBy("user_id").agg(
        F.sum("total_amount").alias("spent"), F.count("total_amount").alias("orders")
    )
    diamond = F.coalesce("flag", F.lit(False)).alias("diamond_buyer")
    return (
        spent.join(buyers, "user_id", "left")
        .groupBy(diamond)
        .agg(
            F.sum("orders").alias("orders"),
            (F.sum("spent").cast("double") / F.sum("orders")).alias("avg_order_value"),
        )
    )


def top_customers(c360: DataFrame, n: int = 10) -> DataFrame:
    best = [F.col("propensity_score").desc_nulls_last(), F.col("user_id")]
    return top_n(c360.select("user_id", "propensity_score", "monetary_total"), best, n)


def top_decile_revenue_share(c360: DataFrame) -> DataFrame:
    top = F.sum(F.when(F.col("decile") == 10, F.col("monetary_total")).otherwise(F.lit(0)))
    return c360.agg(
        (top.cast("double") / F.sum("monetary_total").cast("double")).alias("top_decile_share")
    )


def unit_price_of(items: DataFrame, categories: Collection[str]) -> DataFrame:
    return (
        sales_view(items)
        .query(["avg_unit_price"], by=["category"], where=F.col("category").isin(list(categories)))
        .orderBy("category")
    )


def layer_row_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """One labelled row count per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("layer"), "rows")
        for name, df in layers.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def side_by_side(first: tuple[str, DataFrame], *rest: tuple[str, DataFrame]) -> DataFrame:
    """Row counts of several tables as columns of one row, by scalar subqueries."""
    name, df = first
    base = df.agg(F.count(F.lit(1)).alias(name))
    others = [
        other.agg(F.count(F.lit(1)).alias("n")).scalar().alias(label) for label, other in rest
    ]
    return base.select(name, *others)


def as_of(orders: DataFrame) -> DataFrame:
    return as_of_date(orders)
