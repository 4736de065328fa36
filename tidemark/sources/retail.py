"""The retail schema, derived from the star-schema tables by deterministic expressions.

Every function is a projection (or, for order items, two equi-joins) over whole tables.
Customer keys are INT, since the keyed Murmur3 hash depends on the type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.tables import scan

MONEY = "decimal(18,2)"

# Ids shifted by this much match no customer: used for requests without an answer and
# for stale rows in a serving table.
UNMATCHED_ID_OFFSET = 100_000_000

LOOKUP_FUNCTIONS = (
    "get_customer_propensity",
    "get_customer_profile",
    "recommend_next_best_offer",
)


def _date_from(base: str, key: Column, step: int, span: int) -> Column:
    return F.date_add(F.to_date(F.lit(base)), ((key * step) % span).cast("int"))


def users(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    mail = F.concat(F.lit("user"), key, F.lit("@mail"), key % 5, F.lit(".com"))
    return scan(spark, folder, "customer").select(
        key.cast("int").alias("user_id"),
        F.concat(F.lit("F"), key).alias("first_name"),
        F.col("c_name").alias("last_name"),
        F.when(key % 50 == 0, F.lit(None).cast("string"))
        .when(key % 50 == 1, F.lit("nomail"))
        .otherwise(mail)
        .alias("email"),
        F.when(key % 50 == 2, F.lit("12"))
        .otherwise(F.concat(F.lit("9"), F.lpad(key.cast("string"), 9, "0")))
        .alias("mobile"),
        F.when(key % 97 == 5, F.to_date(F.lit("1988-02-29")))
        .when(key % 3 == 0, F.lit(None).cast("date"))
        .otherwise(_date_from("1985-01-01", key, 53, 9000))
        .alias("anniversary_date"),
        F.when(key % 5 == 0, F.lit(None).cast("date"))
        .otherwise(_date_from("1960-01-01", key, 37, 14000))
        .alias("date_of_birth"),
        F.when(key % 4 == 0, F.to_date(F.lit("2000-06-01"))).alias("milestone_date"),
        _date_from("1994-01-01", key, 17, 360).alias("created_at"),
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").cast("int").alias("user_id"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        (1 + F.col("o_orderkey") % 5).alias("item_count"),
        F.col("o_orderdate").cast("date").alias("created_at"),
    )


def _material(size: Column) -> Column:
    return (
        F.when(size % 10 <= 5, F.lit("18KT Gold & Diamond"))
        .when(size % 10 <= 7, F.lit("22KT GOLD"))
        .when(size % 10 == 8, F.lit("Silver"))
    )


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with customer, date, category and material.

    Only the needed columns enter the joins. Sizes are left to the optimiser: it
    broadcasts a side only below its size threshold, and otherwise sorts and merges,
    splitting a skewed key's partition at run time.
    """
    lines = scan(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("line_total"),
    )
    heads = scan(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").cast("int").alias("user_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
    )
    parts = scan(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_type").alias("category"),
        _material(F.col("p_size")).alias("material"),
        F.col("p_retailprice").cast(MONEY).alias("unit_price"),
    )
    return (
        lines.join(heads, "l_orderkey")
        .join(parts, "l_partkey")
        .select(
            "user_id",
            "category",
            "material",
            "quantity",
            "unit_price",
            "line_total",
            "order_date",
        )
    )


def _engagement(spark: SparkSession, folder: str, event_type: str) -> DataFrame:
    return (
        scan(spark, folder, "events")
        .where(F.col("event_type") == event_type)
        .select(
            (F.col("user_id") * 10 + F.col("event_id") % 10).cast("int").alias("user_id"),
            F.col("value").cast(MONEY).alias("price_inr"),
        )
    )


def carts(spark: SparkSession, folder: str) -> DataFrame:
    return _engagement(spark, folder, "click")


def wishlists(spark: SparkSession, folder: str) -> DataFrame:
    return _engagement(spark, folder, "view")


def products(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "part").select(
        F.concat(F.lit("SKU-"), F.col("p_partkey")).alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        _material(F.col("p_size")).alias("material"),
        F.col("p_retailprice").cast("int").alias("price_inr"),
        F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name")).alias("description"),
        F.concat(F.col("p_type"), F.lit(","), F.col("p_name")).alias("tags"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Three lookup requests per customer; one customer in fifty asks for an unknown id."""
    key = F.col("c_custkey")
    wanted = F.when(key % 50 == 7, key + UNMATCHED_ID_OFFSET).otherwise(key)
    names = F.array(*[F.lit(name) for name in LOOKUP_FUNCTIONS])
    return (
        scan(spark, folder, "customer")
        .select(key, wanted.cast("int").alias("user_id"), F.posexplode(names).alias("pos", "fn"))
        .select((key * 3 + F.col("pos")).alias("request_id"), "fn", "user_id")
    )


def json_requests(spark: SparkSession, folder: str, queries: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """One request per customer as it arrives: a function's name, and arguments as JSON text.

    Six functions in turn, the third always for customer 2; then text that is no JSON, an
    unknown function, and a missing or misfit argument.
    """
    key = F.col("c_custkey")

    def pick(texts: Sequence[str]) -> Column:
        return F.get(F.array(*map(F.lit, texts)), (F.floor(key / 9) % len(texts)).cast("int"))

    def text(**values: Column) -> Column:
        return F.to_json(F.struct(*[value.alias(name) for name, value in values.items()]))

    kinds = [
        ("get_customer_propensity", text(p_user_id=key)),
        ("get_customer_profile", text(p_user_id=key.cast("string"), p_note=F.lit("x"))),
        ("recommend_next_best_offer", text(p_user_id=F.lit(2))),
        ("get_top_prospects", text(p_segment=pick(["High", "Low", "None"]), p_limit=key % 7)),
        ("search_products", text(p_query=pick(queries))),
        ("get_category_performance", text(p_category=pick(categories))),
        ("get_customer_profile", F.concat(F.lit('{"p_user_id": '), key.cast("string"))),
        ("drop_everything", F.lit("{}")),
        ("get_customer_propensity", F.when(key % 2 == 0, F.lit("")).otherwise('{"p_user_id": "many"}')),
    ]
    chosen = F.get(F.array(*[F.struct(F.lit(fn).alias("fn"), a.alias("arguments")) for fn, a in kinds]), (key % 9).cast("int"))
    return scan(spark, folder, "customer").select(key.cast("long").alias("request_id"), chosen.alias("r")).select("request_id", "r.*")


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "labels").select(
        F.col("doc_id").alias("case_id"),
        F.col("quality").alias("grounded"),
        F.col("quality").alias("correct"),
        (1 - F.col("toxic")).alias("safe"),
    )


ORDERS_RAW_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("user_id", T.IntegerType()),
        T.StructField("total_amount", T.DecimalType(18, 2)),
        T.StructField("status", T.StringType()),
        T.StructField("order_date", T.StringType()),
        T.StructField("item_count", T.LongType()),
        T.StructField("created_at", T.StringType()),
    ]
)

ORDER_ITEMS_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("material", T.StringType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("unit_price", T.DecimalType(18, 2)),
        T.StructField("line_total", T.DecimalType(18, 2)),
        T.StructField("order_date", T.DateType()),
    ]
)

USERS_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("mobile", T.StringType()),
        T.StructField("anniversary_date", T.DateType()),
        T.StructField("date_of_birth", T.DateType()),
        T.StructField("milestone_date", T.DateType()),
        T.StructField("created_at", T.DateType()),
    ]
)


def orders_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as landed: dates as text, with faults injected by key."""
    key = F.col("o_orderkey")
    amount = F.col("o_totalprice").cast(MONEY)

    def null_every(step: int, value: Column) -> Column:
        return F.when(key % step != 0, value)

    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return scan(spark, folder, "orders").select(
        null_every(101, key).alias("order_id"),
        null_every(89, F.col("o_custkey").cast("int")).alias("user_id"),
        null_every(97, F.when(key % 83 == 0, -amount).otherwise(amount)).cast(MONEY).alias("total_amount"),
        null_every(107, F.col("o_orderstatus")).alias("status"),
        null_every(103, F.when(key % 211 == 0, F.lit("garbage")).otherwise(day)).alias("order_date"),
        (1 + key % 5).alias("item_count"),
        day.alias("created_at"),
    )
