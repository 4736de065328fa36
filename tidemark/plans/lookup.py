"""Lookups by customer, segment, text or category, and their batch dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.states import (
    diamond_buyer,
    near_occasion,
    offer_rationale,
    recommended_offer,
)
from tidemark.operators.ordered import global_rank, top_n, top_per_group
from tidemark.operators.skew import lookup_join
from tidemark.plans.search import SEARCH_RESULTS

# Fixed value.
CARD_DRIVERS = 5


def _for_user(df: DataFrame, user_id: int | None) -> DataFrame:
    """All customers, or one: the equality reaches the file scan."""
    return df if user_id is None else df.where(F.col("user_id") == user_id)


def customer_propensity(scores: DataFrame, user_id: int | None = None) -> DataFrame:
    return _for_user(scores, user_id).select("user_id", "propensity_score", "segment", "decile")


def customer_profile(features: DataFrame, user_id: int | None = None) -> DataFrame:
    return _for_user(features, user_id).select(
        "user_id",
        "recency_days",
        "frequency",
        F.col("monetary_total").alias("lifetime_value"),
        F.col("aov").cast("decimal(20,2)").alias("aov"),
        F.col("diamond_share").cast("decimal(10,4)").alias("diamond_share"),
        "wishlist_count",
        "cart_adds",
        "days_to_anniversary",
    )


def _offer_columns() -> list[Column]:
    return [
        recommended_offer(
            F.col("days_to_anniversary"), F.col("diamond_share"), F.col("segment"), F.col("cart_adds")
        ).alias("recommended_offer"),
        offer_rationale(
            F.col("segment"),
            F.col("propensity_score"),
            F.col("diamond_share"),
            F.col("days_to_anniversary"),
        ).alias("rationale"),
    ]


def next_best_offer(scores: DataFrame, features: DataFrame, user_id: int | None = None) -> DataFrame:
    """Offer, rationale and score; customers missing from either side are left out."""
    both = _for_user(scores, user_id).join(_for_user(features, user_id), "user_id")
    return both.select("user_id", *_offer_columns(), "propensity_score")


def customer_360(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Features of every customer with their score, where there is one."""
    narrow = scores.select("user_id", "propensity_score", "segment", "decile")
    return features.join(narrow, "user_id", "left")


def top_prospects(scores: DataFrame, segment: str, n: int) -> DataFrame:
    chosen = scores.where(F.col("segment") == segment).select("user_id", "propensity_score")
    return top_n(chosen, [F.col("propensity_score").desc(), F.col("user_id")], n)


def top_prospects_by_segment(scores: DataFrame, n: int) -> DataFrame:
    narrow = scores.select("segment", "user_id", "propensity_score")
    return top_per_group(narrow, "segment", [F.col("propensity_score").desc(), F.col("user_id")], n)


def top_prospects_asked(scores: DataFrame, asks: DataFrame) -> DataFrame:
    """The best ``n`` customers of each segment of a table of asks (segment, n).

    Places are taken from one sort over all segments, so a segment of any size is spread
    over many tasks. Of several asks for one segment the largest counts.
    """
    order = [F.col("segment"), F.col("propensity_score").desc(), F.col("user_id")]
    placed = global_rank(scores.select("segment", "user_id", "propensity_score"), order, "at", "all")
    begins = placed.groupBy("segment").agg(F.min("at").alias("begin"))
    wanted = asks.groupBy("segment").agg(F.max("n").alias("n")).join(begins, "segment")
    return (
        placed.join(wanted, "segment")
        .withColumn("place", F.col("at") - F.col("begin") + 1)
        .where(F.col("place") <= F.col("n"))
        .select("segment", "place", "user_id", "propensity_score")
    )


def category_performance(category_kpis: DataFrame, category: str | None = None) -> DataFrame:
    rows = category_kpis if category is None else category_kpis.where(F.col("category") == category)
    return rows.select("category", "units", "revenue", "avg_unit_price", "diamond_mix")


def golden_cohort(c360: DataFrame, segment: str | None = "High") -> DataFrame:
    """A segment (or all) with diamond affinity, an occasion near, and items in the cart."""
    wanted = c360 if segment is None else c360.where(F.col("segment") == segment)
    return wanted.where(
        diamond_buyer(F.col("diamond_share"))
        & near_occasion(F.col("days_to_anniversary"))
        & (F.col("cart_adds") > 0)
    )


# Functions and the columns of their answers.
_ANSWERS = {
    "get_customer_propensity": ["propensity_score", "segment", "decile"],
    "get_customer_profile": [
        "recency_days",
        "frequency",
        "lifetime_value",
        "aov",
        "diamond_share",
        "wishlist_count",
        "cart_adds",
        "days_to_anniversary",
    ],
    "recommend_next_best_offer": ["recommended_offer", "rationale", "propensity_score"],
}


def answer_requests(requests: DataFrame, features: DataFrame, scores: DataFrame) -> DataFrame:
    """Answers to many lookup requests (request_id, fn, user_id) with one lookup join.

    Every request row gets the columns of its function, the others staying NULL, and
    ``found`` tells whether the function would have returned a row. One customer may be
    asked for in any share of the requests.
    """
    unknown = scores.select("user_id", F.lit(True).alias("has_score"), "propensity_score", "segment", "decile")
    known = (
        features.withColumn("has_features", F.lit(True))
        .join(unknown, "user_id", "full_outer")
        .withColumn("lifetime_value", F.col("monetary_total"))
    )
    offers = known.select("*", *_offer_columns())
    answered = lookup_join(requests, offers, "user_id")
    has_score = F.coalesce("has_score", F.lit(False))
    has_features = F.coalesce("has_features", F.lit(False))
    found = (
        F.when(F.col("fn") == "get_customer_propensity", has_score)
        .when(F.col("fn") == "get_customer_profile", has_features)
        .when(F.col("fn") == "recommend_next_best_offer", has_score & has_features)
        .otherwise(F.lit(False))
    )
    names = list(dict.fromkeys(n for columns in _ANSWERS.values() for n in columns))
    answers = []
    for name in names:
        askers = [fn for fn, columns in _ANSWERS.items() if name in columns]
        answers.append(F.when(found & F.col("fn").isin(askers), F.col(name)).alias(name))
    return answered.select("request_id", "fn", "user_id", found.alias("found"), *answers)


def customer_cards(features: DataFrame, scores: DataFrame, drivers: DataFrame, weight: str) -> DataFrame:
    """Score, profile and the strongest global drivers, for every customer.

    The drivers are a few rows, one per feature; their top names enter as one scalar.
    """
    strongest = top_n(drivers, [F.col(weight).desc(), F.col("feature")], CARD_DRIVERS)
    names = strongest.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col(weight)).alias("w"), F.col("feature")))),
            lambda item: item["feature"],
        ).alias("names")
    ).scalar()
    return customer_360(features, scores).select(
        "user_id",
        "propensity_score",
        "segment",
        "decile",
        "recency_days",
        "frequency",
        "monetary_total",
        "diamond_share",
        "days_to_anniversary",
        names.alias("why_top_drivers"),
    )


def _register_lookup(
    spark: SparkSession, function: str, rows: DataFrame, parameters: dict[str, str], condition: str
) -> None:
    """SQL table function that filters a named view of ``rows``."""
    view = f"{function}_rows"
    rows.createOrReplaceTempView(view)
    arguments = ", ".join(f"{name} {kind}" for name, kind in parameters.items())
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = ", ".join(rows.columns)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {function}({arguments}) RETURNS TABLE({columns}) "
        f"RETURN SELECT {names} FROM {view} WHERE {condition}"
    )


def register_sql_functions(
    spark: SparkSession,
    features: DataFrame,
    scores: DataFrame,
    products: DataFrame,
    category_kpis: DataFrame,
) -> None:
    """SQL table functions over the same definitions, for single calls.

    The filter of a call is pushed through the function into the scans beneath it. For
    many requests at a time there are ``answer_requests``, ``search_products_asked`` and
    ``top_prospects_asked``, which keep a frequent key or a large segment out of one task.
    """
    by_user = ({"wanted_user": "INT"}, "user_id = wanted_user")
    _register_lookup(spark, "get_customer_propensity", customer_propensity(scores), *by_user)
    _register_lookup(spark, "get_customer_profile", customer_profile(features), *by_user)
    _register_lookup(spark, "recommend_next_best_offer", next_best_offer(scores, features), *by_user)
    order = W.partitionBy("segment").orderBy(F.col("propensity_score").desc(), "user_id")
    placed = scores.select("segment", "user_id", "propensity_score", F.row_number().over(order).alias("place"))
    _register_lookup(
        spark,
        "get_top_prospects",
        placed,
        {"wanted_segment": "STRING", "wanted_rows": "INT"},
        "segment = wanted_segment AND place <= wanted_rows",
    )
    _register_lookup(
        spark,
        "search_products",
        products,
        {"wanted_text": "STRING"},
        "exists(array(name, description, tags), held -> held ILIKE concat('%',"
        r" regexp_replace(wanted_text, '(\\\\[%_\\\\])|(\\\\)', '$1$2$2'), '%'))"
        f" ORDER BY price_inr DESC, product_id LIMIT {SEARCH_RESULTS}",
    )
    _register_lookup(
        spark,
        "get_category_performance",
        category_performance(category_kpis),
        {"wanted_category": "STRING"},
        "category = wanted_category",
    )
