"""Every operator as a named query over a source folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import days_to_recurrence
from tidemark.functions.states import engagement_state
from tidemark.functions.text_guard import BANNED_KEYWORDS
from tidemark.operators import curve, quality
from tidemark.operators.ordered import equal_frequency_bucket, global_rank, top_n
from tidemark.operators.profile import profile
from tidemark.plans import features as feat
from tidemark.plans import gateway, governance, kpis, lookup, model, propensity, publish, questions, requests, search
from tidemark.plans.lakehouse import Lakehouse, open_lakehouse
from tidemark.plans.views import register_views
from tidemark.session import run_dir
from tidemark.sources import retail
from tidemark.sources.tables import TableStore, scan
from tidemark.streaming import gateway as gateway_streams
from tidemark.streaming.ingest import RESCUED, UNREADABLE, Medallion

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

GUARD_KEYWORDS = [*BANNED_KEYWORDS, "token"]
SEARCHES = ["ring", "small", "blue bolt", "BRAND#1", "r%g", "ECONOMY,red", "nothing like it"]
SAMPLE_LABEL, SAMPLE_SCORE = propensity.LABEL, propensity.TRUE_PROPENSITY


def _plain(df: DataFrame) -> DataFrame:
    """Portable result types: decimals as DOUBLE, dates and times as text."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str):
    """Register a function of a lakehouse under ``name``."""

    def register(build: Callable[[Lakehouse], DataFrame]) -> Callable[[Lakehouse], DataFrame]:
        QUERIES[name] = lambda spark, folder: _plain(build(open_lakehouse(spark, folder)))
        return build

    return register


def _store(lake: Lakehouse, purpose: str) -> TableStore:
    return TableStore(lake.spark, run_dir(lake.spark, purpose))


def _nullable(df: DataFrame, *names: str) -> DataFrame:
    """Whole-number columns that hold NULLs, as DOUBLE, which every client shows alike."""
    return df.withColumns({name: F.col(name).cast("double") for name in names})


_RAW_KEYS = ("order_id", "user_id")


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


# --- Sources and sinks ---------------------------------------------------------------


def _landed(lake: Lakehouse, df: DataFrame) -> str:
    """Write ``df`` as JSON files, as the upstream system would."""
    path = run_dir(lake.spark, "landing")
    df.write.json(path)
    return path


def _medallion(lake: Lakehouse) -> Medallion:
    return Medallion(lake.spark, run_dir(lake.spark, "medallion"))


def _bronze(lake: Lakehouse, df: DataFrame, schema: T.StructType) -> DataFrame:
    table = _medallion(lake).ingest(_landed(lake, df), "bronze", schema)
    return table.withColumn("has_source", F.col("_source_file").endswith(".json")).drop(
        "_source_file", "_bronze_ingested_at", RESCUED, UNREADABLE
    )


@query("a01_ingest_orders")
def _(lake):
    return _nullable(_bronze(lake, lake.orders_raw(), retail.ORDERS_RAW_SCHEMA), *_RAW_KEYS)


@query("a01_ingest_faulty")
def _(lake):
    """Landed lines with faults by key: an unknown field, a broken line, misfit values."""
    fields = ["order_id", "user_id", "total_amount", "status"]
    line, kind = F.to_json(F.struct(*fields)), F.col("order_id") % 11
    lines = lake.orders().select(
        F.when(kind == 1, F.concat(F.rtrim(line, F.lit("}")), F.lit(',"coupon":"c7"}')))
        .when(kind == 2, F.substring(line, 1, 30))
        .when(kind == 3, F.regexp_replace(line, '"user_id":', '"user_id":7.5,"was":'))
        .when(kind == 4, F.regexp_replace(line, '"total_amount":[0-9.]+', '"total_amount":"12.345"'))
        .otherwise(line)
        .alias("value")
    )
    landing = run_dir(lake.spark, "landing")
    lines.write.text(landing)
    table = _medallion(lake).ingest(landing, "bronze", retail.ORDERS_RAW_SCHEMA)
    return _nullable(table.select(*fields, RESCUED, UNREADABLE), *_RAW_KEYS)


@query("a01_ingest_growing")
def _(lake):
    """Three landings; from the second on with two new fields and an amount that comes as text."""
    fields = ["order_id", "user_id", "total_amount", "status"]
    key = F.col("order_id")
    plain = F.to_json(F.struct(*fields))
    more = F.to_json(
        F.struct(
            *fields[:2],
            F.when(key % 4 == 1, F.concat(F.col("total_amount").cast("string"), F.lit(" EUR")))
            .otherwise(F.col("total_amount").cast("string"))
            .alias("total_amount"),
            "status",
            (key * 2).alias("points"),
            F.concat(F.lit("c"), key % 5).alias("coupon"),
        )
    )
    lines = lake.orders().select(key, F.when(key % 3 == 0, plain).otherwise(more).alias("value"))
    landing, medallion = run_dir(lake.spark, "landing"), _medallion(lake)
    for part in range(3):
        lines.where(key % 3 == part).select("value").write.mode("append").text(landing)
        table = medallion.ingest_growing(landing, "bronze", retail.ORDERS_RAW_SCHEMA)
        if part == 1:
            medallion.promote_fields("bronze", retail.ORDERS_RAW_SCHEMA)
    return _nullable(table.select(*fields, "points", "coupon", "total_amount_string", RESCUED), *_RAW_KEYS, "points")


@query("a02_ingest_order_items")
def _(lake):
    return _bronze(lake, lake.items(), retail.ORDER_ITEMS_SCHEMA)


@query("a03_ingest_users")
def _(lake):
    return _bronze(lake, lake.users(), retail.USERS_SCHEMA)


def _streamed_orders(lake: Lakehouse, mode: str = "complete") -> Medallion:
    medallion = _medallion(lake)
    medallion.ingest(_landed(lake, lake.orders_raw()), "orders_bronze", retail.ORDERS_RAW_SCHEMA)
    medallion.split("orders_bronze", mode=mode)
    return medallion


@query("a04_stream_silver")
def _(lake):
    return _streamed_orders(lake).silver()


@query("a05_batch_scan")
def _(lake):
    return lake.orders()


@query("a06_replace_table")
def _(lake):
    store = _store(lake, "replace")
    store.replace("orders_clean", lake.orders_raw())
    return store.replace("orders_clean", quality.clean(lake.orders_raw(), quality.order_rules()))


@query("a07_overwrite_with_new_schema")
def _(lake):
    store = _store(lake, "overwrite")
    store.replace("scores", lake.scores().select("user_id", "propensity_score"))
    table = store.replace("scores", lake.scores())
    return table.withColumn("scored_at", F.col("scored_at") <= F.current_timestamp())


@query("a08_gold_refresh")
def _(lake):
    medallion = _streamed_orders(lake)
    medallion.ingest(_landed(lake, lake.items()), "items_bronze", retail.ORDER_ITEMS_SCHEMA)
    medallion.ingest(_landed(lake, lake.users()), "users_bronze", retail.USERS_SCHEMA)
    return medallion.refresh_gold("items_bronze", "users_bronze")


@query("a08_gold_merged")
def _(lake):
    """The gold features kept up to date batch by batch: three landings, merged one by one."""
    medallion = _medallion(lake)
    tables = [
        ("orders_bronze", lake.orders_raw(), retail.ORDERS_RAW_SCHEMA),
        ("items_bronze", lake.items(), retail.ORDER_ITEMS_SCHEMA),
        ("users_bronze", lake.users(), retail.USERS_SCHEMA),
    ]
    landings = {name: run_dir(lake.spark, "landing") for name, _, _ in tables}
    for part in range(3):
        for name, rows, schema in tables:
            rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(3)) == part).write.mode("append").json(landings[name])
            medallion.ingest(landings[name], name, schema)
        medallion.merge_gold("orders_bronze", "items_bronze", "users_bronze")
    return medallion.merged_gold()


_OLD_STAMP = "2000-01-01 00:00:00"


def _old_serving(lake: Lakehouse) -> DataFrame:
    """An earlier serving table: lower scores, and every other customer since gone."""
    key = F.col("user_id")
    stale = F.when(key % 2 == 0, key).otherwise(key + retail.UNMATCHED_ID_OFFSET)
    return publish.serving_projection(lake.scores()).select(
        stale.cast("int").alias("user_id"),
        F.round(F.col("propensity_score") - 0.1, 6).alias("propensity_score"),
        "segment",
        "decile",
        F.to_timestamp(F.lit(_OLD_STAMP)).alias("scored_at"),
    )


def _synced(lake: Lakehouse) -> DataFrame:
    return publish.sync_scores(_old_serving(lake), lake.scores())


@query("a09_upsert_scores")
def _(lake):
    store = _store(lake, "serving")
    publish.first_serving(store, "scores", _old_serving(lake))
    table = publish.sync_serving(store, "scores", lake.scores())
    fresh = F.col("scored_at") > F.to_timestamp(F.lit(_OLD_STAMP))
    return table.withColumn("refreshed", fresh).drop("scored_at")


@query("a10_serving_projection")
def _(lake):
    return publish.serving_projection(lake.scores())


@query("a11_append_evaluation")
def _(lake):
    store = _store(lake, "evaluations")
    row = publish.evaluation_row(
        publish.evaluation_summary(retail.verdicts(lake.spark, lake.folder))
    )
    store.append("results", row)
    table = store.append("results", row)
    return _rounded(table.drop("evaluated_at"), 9, "groundedness", "correctness", "safety")


@query("a12_payload_log")
def _(lake):
    stream = gateway_streams.parquet_stream(lake.spark, lake.folder, "conversations")
    return gateway_streams.payload_log(stream, _store(lake, "payloads")).drop("logged_at")


# --- Projections, filters, predicates ------------------------------------------------


@query("b01_expectation_counts")
def _(lake):
    return quality.violation_counts(lake.orders_raw(), quality.order_rules())


@query("b01_expectation_counts_stream")
def _(lake):
    return _streamed_orders(lake).violations()


@query("b02_batch_clean")
def _(lake):
    return quality.clean(lake.orders_raw(), quality.order_rules())


@query("b03_quarantine_safe")
def _(lake):
    return _nullable(quality.quarantine(lake.orders_raw(), quality.order_rules()), *_RAW_KEYS)


@query("b03_quarantine_reference")
def _(lake):
    held = quality.quarantine(lake.orders_raw(), quality.order_rules(), mode="reference")
    return _nullable(held, *_RAW_KEYS)


@query("b03_quarantine_stream")
def _(lake):
    held = _streamed_orders(lake).quarantined().drop(
        "_source_file", "_bronze_ingested_at", RESCUED, UNREADABLE
    )
    return _nullable(held, *_RAW_KEYS)


@query("b03_quarantine_bad_dates")
def _(lake):
    rules = [*quality.order_rules(), quality.readable_date_rule()]
    return _nullable(quality.quarantine(lake.orders_raw(), rules), *_RAW_KEYS)


@query("b04_silver_projection")
def _(lake):
    return _nullable(quality.silver_orders(lake.orders_raw()), *_RAW_KEYS)


def _dimension(lake: Lakehouse) -> DataFrame:
    return governance.customer_dimension(lake.users(), portable=True)


@query("b05_mask_email")
def _(lake):
    masked = governance.mask_email(F.col("email"), ["analysts"])
    return lake.users().select("user_id", masked.alias("email"))


@query("b06_mask_mobile")
def _(lake):
    masked = governance.mask_mobile(F.col("mobile"), ["analysts"])
    return lake.users().select("user_id", masked.alias("mobile"))


@query("b07_row_filter_analyst")
def _(lake):
    return governance.governed_customers(_dimension(lake), ["analysts"])


@query("b07_row_filter_admin")
def _(lake):
    return governance.governed_customers(_dimension(lake), ["admins"])


@query("b08_region_murmur")
def _(lake):
    return governance.customer_dimension(lake.users()).select("user_id", "region")


@query("b08_region_portable")
def _(lake):
    return _dimension(lake).select("user_id", "region")


@query("b09_engagement_state")
def _(lake):
    state = engagement_state(F.col("recency_days")).alias("engagement_state")
    return lake.features().select("user_id", "recency_days", state)


@query("b10_segment")
def _(lake):
    return lake.scores().select("user_id", "decile", "segment")


@query("b11_next_best_offer")
def _(lake):
    return lookup.next_best_offer(lake.scores(), lake.features())


# A customer, a number that no customer has, and a category.
PRESENT_USER, ABSENT_USER, ASKED_CATEGORY = 7, -1, "LARGE"


@query("b12_propensity_lookup")
def _(lake):
    return lookup.customer_propensity(lake.scores(), PRESENT_USER)


@query("b12_propensity_lookup_absent")
def _(lake):
    """No row for an unknown customer; counted, so that the answer has one."""
    found = lookup.customer_propensity(lake.scores(), ABSENT_USER)
    return found.agg(F.count(F.lit(1)).alias("rows"))


@query("b13_profile_lookup")
def _(lake):
    return lookup.customer_profile(lake.features(), PRESENT_USER)


@query("b14_category_lookup")
def _(lake):
    return lookup.category_performance(lake.category_kpis(), ASKED_CATEGORY)


@query("b15_search_products")
def _(lake):
    return search.search_products(lake.products(), "ring")


@query("b15_search_many")
def _(lake):
    return search.search_products_many(lake.products(), SEARCHES)


@query("b15_search_many_literal")
def _(lake):
    return search.search_products_many(lake.products(), SEARCHES, literal=True)


def _asked_searches(lake: Lakehouse) -> DataFrame:
    """The searches as a table; each is asked for by one part key, repeatedly."""
    texts = F.array(*map(F.lit, SEARCHES))
    return lake.products().select(
        F.get(texts, F.pmod(F.xxhash64("product_id"), F.lit(len(SEARCHES))).cast("int")).alias("query")
    )


@query("b15_search_table")
def _(lake):
    return search.search_products_asked(lake.products(), _asked_searches(lake))


@query("b15_search_table_literal")
def _(lake):
    return search.search_products_asked(lake.products(), _asked_searches(lake), literal=True)


@query("b15_search_index")
def _(lake):
    """Searches of every kind by the stored index: long, short, wildcards alone, escaped."""
    kinds = [*SEARCHES, "r", "SM", "_", "%", "", "r_d%s", "50\\%", "a\\_b", "\\", "nk_i%l\\", "_" * 30]
    asked = lake.products().select(F.explode(F.array(*map(F.lit, kinds))).alias("query"))
    return search.search_products_asked(lake.products(), asked, index=lake.search_index())


@query("b16_golden_cohort")
def _(lake):
    wanted = ["user_id", "propensity_score", "diamond_share", "days_to_anniversary", "cart_adds"]
    return lookup.golden_cohort(lake.c360()).select(*wanted)


@query("b16_occasion_cohort")
def _(lake):
    """The cohort without the propensity condition, which is rarely empty."""
    wanted = ["user_id", "diamond_share", "days_to_anniversary", "cart_adds"]
    return lookup.golden_cohort(lake.c360(), segment=None).select(*wanted)


@query("b17_guard_documents")
def _(lake):
    documents = scan(lake.spark, lake.folder, "documents")
    return gateway.guard(documents, "text", ["doc_id"], GUARD_KEYWORDS)


@query("b17_guard_conversations")
def _(lake):
    messages = scan(lake.spark, lake.folder, "conversations")
    return gateway.guard(messages, "text", ["conv_id", "turn"], GUARD_KEYWORDS)


@query("b18_leakage_safe_features")
def _(lake):
    return propensity.leakage_safe(lake.training())


@query("b19_numeric_features")
def _(lake):
    return propensity.numeric_features(lake.training())


# --- Joins ---------------------------------------------------------------------------


@query("c01_reference_date")
def _(lake):
    ref = feat.as_of_date(lake.orders()).scalar()
    return lake.users().select("user_id", ref.alias("ref_date"))


@query("c02_column_statistics")
def _(lake):
    return propensity.standard_scores(lake.features()).select(
        "user_id", F.round("z_frequency", 6).alias("z_frequency")
    )


@query("c03_feature_star")
def _(lake):
    return lake.build_features()


@query("c04_customer_360")
def _(lake):
    return lake.c360()


@query("c05_scores_with_features")
def _(lake):
    both = lake.scores().join(lake.features(), "user_id")
    return both.select("user_id", "segment", "propensity_score", "diamond_share", "cart_adds")


@query("c06_counts_side_by_side")
def _(lake):
    rules = quality.order_rules()
    return questions.side_by_side(
        ("orders_clean", quality.clean(lake.orders_raw(), rules)),
        ("orders_quarantined", quality.quarantine(lake.orders_raw(), rules)),
    )


@query("c07_answer_requests")
def _(lake):
    requests = retail.requests(lake.spark, lake.folder)
    answers = lookup.answer_requests(requests, lake.features(), lake.scores())
    counts = ("decile", "recency_days", "frequency", "wishlist_count", "cart_adds", "days_to_anniversary")
    return _nullable(answers, *counts)


CATEGORIES = ["ECONOMY", "LARGE", "nothing"]


@query("c07_json_requests")
def _(lake):
    """Requests of all six functions with JSON arguments, sound and faulty."""
    asked = retail.json_requests(lake.spark, lake.folder, SEARCHES, CATEGORIES)
    performance = lake.category_kpis()  # stores the order items, which the features then read
    answers = requests.answer_requests(
        asked, lake.features(), lake.scores(), lake.products(), performance, lake.search_index()
    )
    whole = [f.name for f in answers.schema if isinstance(f.dataType, (T.IntegerType, T.LongType))]
    return _nullable(answers, *[n for n in whole if n != "request_id"])


# --- Aggregations --------------------------------------------------------------------


@query("d01_as_of_date")
def _(lake):
    return questions.as_of(lake.orders())


@query("d02_order_features")
def _(lake):
    df = feat.order_features(lake.orders())
    return df.withColumns({"aov": F.round("aov", 2), "avg_item_count": F.round("avg_item_count", 3)})


@query("d03_item_features")
def _(lake):
    return _rounded(feat.item_features(lake.items()), 4, "diamond_share", "gold_share")


@query("d04_cart_features")
def _(lake):
    return feat.engagement_features(lake.carts(), "cart_adds", "cart_value")


@query("d05_wishlist_features")
def _(lake):
    return feat.engagement_features(lake.wishlists(), "wishlist_count", "wishlist_value")


@query("d06_occasion_features")
def _(lake):
    ref = feat.as_of_date(lake.orders()).scalar()
    return feat.occasion_features(lake.users(), ref)


@query("d06_occasion_leap_feb28")
def _(lake):
    ref = feat.as_of_date(lake.orders()).scalar()
    days = days_to_recurrence(F.col("anniversary_date"), ref, leap="feb28")
    return lake.users().select("user_id", days.alias("days_to_anniversary"))


@query("d07_feature_statistics")
def _(lake):
    df = propensity.feature_statistics(lake.features())
    return _rounded(df, 6, *df.columns)


@query("d08_sales_by_category_month")
def _(lake):
    view = kpis.sales_view(lake.items())
    return view.query(kpis.SALES_MEASURES, by=["category", "order_month"])


@query("d09_category_kpi")
def _(lake):
    return lake.category_kpis()


@query("d10_daily_sales_kpi")
def _(lake):
    return kpis.daily_sales_kpi(lake.orders(), lake.items())


@query("d11_customer_value_kpi")
def _(lake):
    return kpis.customer_value_kpi(lake.features())


@query("d12_propensity_measures")
def _(lake):
    view = kpis.propensity_view(lake.c360())
    df = view.query(kpis.PROPENSITY_MEASURES, by=["segment", "engagement_state"])
    return _rounded(df, 9, "avg_propensity")


@query("d13_sales_measures_global")
def _(lake):
    return kpis.sales_view(lake.items()).query(kpis.SALES_MEASURES)


@query("d13_propensity_measures_global")
def _(lake):
    df = kpis.propensity_view(lake.c360()).query(kpis.PROPENSITY_MEASURES)
    return _rounded(df, 9, "avg_propensity")


@query("d14_measures_with_filter")
def _(lake):
    return questions.segment_comparison(lake.c360())


@query("d14_group_by_all")
def _(lake):
    lake.c360().createOrReplaceTempView("customer_360")
    return lake.spark.sql(
        "SELECT segment, count(DISTINCT user_id) AS customers,"
        " CAST(sum(monetary_total) AS DOUBLE) / count(monetary_total) AS avg_lifetime_value"
        " FROM customer_360 WHERE segment IN ('High', 'Low') GROUP BY ALL"
    )


@query("d15_segment_summary")
def _(lake):
    return kpis.segment_summary(lake.scores())


@query("d16_sync_check")
def _(lake):
    return publish.sync_check(_synced(lake))


@query("d17_evaluation_summary")
def _(lake):
    df = publish.evaluation_summary(retail.verdicts(lake.spark, lake.folder))
    return _rounded(df, 9, "groundedness", "correctness", "safety")


@query("d18_table_profile")
def _(lake):
    scored_at = feat.as_of_date(lake.orders()).scalar()
    df = profile(lake.scores().withColumn("scored_at", scored_at), unique=["user_id"])
    return _rounded(_nullable(df, "distinct_count"), 6, "mean", "stddev")


@query("d18_feature_profile")
def _(lake):
    df = _nullable(profile(lake.features(), unique=["user_id"]), "distinct_count")
    return _rounded(df, 6, "mean", "stddev")


@query("d19_usage_per_user_day")
def _(lake):
    events = scan(lake.spark, lake.folder, "events")
    return gateway.calls_per_window(events, F.col("user_id"), "1 day")


@query("d20_book_size")
def _(lake):
    return kpis.book_size(lake.c360())


@query("d21_base_rate")
def _(lake):
    return lake.training().agg(F.avg(F.col(SAMPLE_LABEL).cast("double")).alias("base_rate"))


# --- Ranking -------------------------------------------------------------------------


@query("e01_top_prospects")
def _(lake):
    return lookup.top_prospects(lake.scores(), "High", 5)


@query("e01_top_prospects_by_segment")
def _(lake):
    return lookup.top_prospects_by_segment(lake.scores(), 5)


@query("e01_prospects_asked")
def _(lake):
    """As many prospects of a segment as it has deciles, asked for by a table."""
    asks = lake.scores().groupBy("segment").agg(F.count_distinct("decile").alias("n"))
    return lookup.top_prospects_asked(lake.scores(), asks)


@query("e02_rank_of_measure")
def _(lake):
    return questions.revenue_by_category(lake.items())


@query("e03_decile")
def _(lake):
    narrow = lake.training().select("user_id", SAMPLE_SCORE)
    ranked = global_rank(narrow, [F.col(SAMPLE_SCORE), F.col("user_id")])
    decile = equal_frequency_bucket(F.col("rank"), F.col("total"))
    return ranked.withColumn("decile", decile)


@query("e04_average_precision")
def _(lake):
    df = curve.average_precision(lake.training(), SAMPLE_LABEL, SAMPLE_SCORE)
    return _rounded(df, 9, "average_precision")


@query("e05_roc_auc")
def _(lake):
    return _rounded(curve.roc_auc(lake.training(), SAMPLE_LABEL, SAMPLE_SCORE), 9, "roc_auc")


@query("e06_brier")
def _(lake):
    loss = curve.brier(F.col(SAMPLE_LABEL).cast("double"), F.col(SAMPLE_SCORE))
    return lake.training().agg(F.round(loss, 9).alias("brier"))


@query("e07_precision_at_decile")
def _(lake):
    df = curve.precision_at_fraction(lake.training(), SAMPLE_LABEL, SAMPLE_SCORE, "user_id")
    return _rounded(df, 9, "base_rate", "precision_at_k", "lift_at_k")


# --- Sorts, limits, set operations ---------------------------------------------------


@query("f01_top_customers_by_value")
def _(lake):
    wanted = lake.features().select("user_id", "frequency", "monetary_total", "aov")
    return top_n(wanted, [F.col("monetary_total").desc(), F.col("user_id")], 5)


@query("f01_top_drivers")
def _(lake):
    drivers = propensity.term_contributions(lake.features())
    top = top_n(drivers, [F.col("mean_abs_contribution").desc(), F.col("feature")], 5)
    return _rounded(top, 6, "mean_abs_contribution")


@query("f01_top_model_drivers")
def _(lake):
    return top_n(lake.drivers(), [F.col("mean_abs_contribution").desc(), F.col("feature")], 10)


@query("f01_latest_evaluations")
def _(lake):
    """Six evaluations, each of the cases of its own remainder of the key; five are shown."""
    store = _store(lake, "evaluations")
    verdicts = retail.verdicts(lake.spark, lake.folder)
    for run in range(6):
        summary = publish.evaluation_summary(verdicts.where(F.col("case_id") % 6 >= run))
        table = store.append("results", publish.evaluation_row(summary))
    latest = publish.latest_evaluations(table).drop("evaluated_at")
    return _rounded(latest, 9, "groundedness", "correctness", "safety")


@query("f02_multi_key_sort")
def _(lake):
    return lake.category_kpis().orderBy(F.col("revenue").desc(), "category")


@query("f03_sort_by_ordinal")
def _(lake):
    return lake.scores().groupBy("segment").agg(F.count(F.lit(1)).alias("customers")).orderBy(2, 1)


@query("g01_layer_row_counts")
def _(lake):
    rules = quality.order_rules()
    raw = lake.orders_raw()
    return questions.layer_row_counts(
        {
            "orders_bronze": raw,
            "orders_silver": quality.clean(raw, rules),
            "orders_quarantine": quality.quarantine(raw, rules),
            "customer_features": lake.features(),
        }
    )


# --- Rate limits ---------------------------------------------------------------------


def _events(lake: Lakehouse) -> DataFrame:
    return scan(lake.spark, lake.folder, "events")


@query("g01_sql_layer_counts")
def _(lake):
    register_views(lake)
    return lake.spark.sql(
        "SELECT 'orders_clean' AS layer, count(*) AS rows FROM orders_clean"
        " UNION ALL SELECT 'orders_quarantine', count(*) FROM orders_quarantine"
        " UNION ALL SELECT 'customer_features', count(*) FROM customer_features"
        " UNION ALL SELECT 'customer_nbo_scores', count(*) FROM customer_nbo_scores"
    )


@query("c06_sql_scalar_counts")
def _(lake):
    register_views(lake)
    return lake.spark.sql(
        "SELECT (SELECT count(*) FROM customer_features) AS feature_rows,"
        " (SELECT count(*) FROM customer_360 WHERE segment IS NOT NULL) AS scored_rows"
    )


@query("r01_user_calls_per_minute")
def _(lake):
    calls = gateway.calls_per_window(_events(lake), F.col("user_id"), "1 minute")
    return calls.withColumn("over_limit", F.col("calls") > gateway.USER_CALLS_PER_MINUTE)


@query("r01_endpoint_calls_per_minute")
def _(lake):
    calls = gateway.calls_per_window(_events(lake), F.col("event_type"), "1 minute")
    return calls.withColumn("over_limit", F.col("calls") > gateway.ENDPOINT_CALLS_PER_MINUTE)


@query("r01_users_over_daily_limit")
def _(lake):
    return gateway.over_limit(_events(lake), F.col("user_id"), 5, "1 day")


@query("r01_rolling_user_limit")
def _(lake):
    """Callers by their calls in any six hours, against a limit of three."""
    return gateway.callers_over_limit(_events(lake), F.col("user_id"), 3, 6 * 3600)


@query("r01_rolling_endpoint_limit")
def _(lake):
    return gateway.callers_over_limit(_events(lake), F.col("event_type"), gateway.ENDPOINT_CALLS_PER_MINUTE)


@query("r01_stream_users_over_daily_limit")
def _(lake):
    stream = gateway_streams.parquet_stream(lake.spark, lake.folder, "events")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    calls = gateway_streams.running_windows(
        stream, F.col("user_id"), "1 day", "10 minutes", _store(lake, "limits"), "calls"
    )
    return calls.where(F.col("calls") > 5)


@query("r01_stream_closed_windows")
def _(lake):
    stream = gateway_streams.parquet_stream(lake.spark, lake.folder, "events")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return gateway_streams.closed_windows(
        stream, F.col("user_id"), "1 day", "10 minutes", _store(lake, "limits"), "calls"
    )


# --- Functions and model -------------------------------------------------------------


@query("h01_sql_masks")
def _(lake):
    governance.register_sql_masks(lake.spark, ["analysts"])
    return _dimension(lake).selectExpr(
        "user_id",
        "mask_email(email) AS email",
        "mask_mobile(mobile) AS mobile",
        "region_filter(region) AS visible",
    )


def _sql_functions(lake: Lakehouse) -> None:
    lookup.register_sql_functions(
        lake.spark, lake.features(), lake.scores(), lake.products(), lake.category_kpis()
    )


@query("h02_sql_propensity_lateral")
def _(lake):
    _sql_functions(lake)
    retail.requests(lake.spark, lake.folder).createOrReplaceTempView("lookup_requests")
    return lake.spark.sql(
        "SELECT r.request_id, p.propensity_score, p.segment, p.decile FROM lookup_requests AS r,"
        " LATERAL get_customer_propensity(r.user_id) AS p"
    )


@query("h02_sql_offers_lateral")
def _(lake):
    _sql_functions(lake)
    lake.users().createOrReplaceTempView("lookup_users")
    return lake.spark.sql(
        "SELECT u.user_id, o.recommended_offer, o.rationale FROM lookup_users AS u,"
        " LATERAL recommend_next_best_offer(u.user_id) AS o"
    )


@query("h02_sql_top_prospects")
def _(lake):
    _sql_functions(lake)
    return lake.spark.sql("SELECT user_id, propensity_score FROM get_top_prospects('High', 5)")


@query("h02_sql_search_products")
def _(lake):
    _sql_functions(lake)
    return lake.spark.sql(
        "SELECT product_id, name, category, material, price_inr FROM search_products('ring')"
    )


@query("h02_sql_profile_lateral")
def _(lake):
    _sql_functions(lake)
    retail.requests(lake.spark, lake.folder).createOrReplaceTempView("lookup_requests")
    return lake.spark.sql(
        "SELECT r.request_id, p.* FROM lookup_requests AS r, LATERAL get_customer_profile(r.user_id) AS p"
    )


@query("h02_sql_category_lateral")
def _(lake):
    _sql_functions(lake)
    lake.category_kpis().createOrReplaceTempView("asked_categories")
    return lake.spark.sql(
        "SELECT p.* FROM asked_categories AS a, LATERAL get_category_performance(a.category) AS p"
    )


@query("h04_standard_scores")
def _(lake):
    df = propensity.standard_scores(lake.features())
    names = [name for name in df.columns if name.startswith("z_")]
    return _rounded(df.select("user_id", *names), 6, *names)


@query("h05_latent_propensity")
def _(lake):
    df = propensity.latent_propensity(lake.features())
    return _rounded(df.select("user_id", "latent", "propensity"), 6, "latent", "propensity")


@query("h06_label_murmur")
def _(lake):
    return propensity.training_dataset(lake.features()).select("user_id", SAMPLE_LABEL)


@query("h06_training_dataset")
def _(lake):
    return propensity.training_dataset(lake.features(), portable=True)


@query("h07_stratified_split")
def _(lake):
    split = propensity.stratified_split(lake.training(), portable=True)
    return split.select("user_id", SAMPLE_LABEL, "is_train")


@query("h03_model_scores")
def _(lake):
    """Score, decile and segment that the stored trees give every customer."""
    return model.score_all(lake.model(), lake.training())


@query("h08_model_trees")
def _(lake):
    """The nodes of the fitted trees: feature and edge of a split, value and rows of a node."""
    return _nullable(lake.model_trees(), "left", "right", "rows")


@query("h08_model_metrics")
def _(lake):
    """Metrics of the model on the held-out rows."""
    held_out = lake.held_out()
    report = model.evaluate(lake.model(), held_out)
    return report.withColumn("rows", held_out.agg(F.count(F.lit(1))).scalar())


@query("h09_model_contributions")
def _(lake):
    """What each feature adds to the log odds of every held-out customer."""
    return model.contributions(lake.model(), lake.held_out())


@query("h09_model_drivers")
def _(lake):
    """Mean size of each feature's contributions over all held-out customers."""
    return lake.drivers()


@query("h09_term_contributions")
def _(lake):
    return _rounded(propensity.term_contributions(lake.features()), 6, "mean_abs_contribution")


@query("h10_customer_cards")
def _(lake):
    drivers = propensity.term_contributions(lake.features())
    cards = lookup.customer_cards(
        lake.features(), lake.scores(), drivers, "mean_abs_contribution"
    )
    return cards.withColumn("why_top_drivers", F.array_join("why_top_drivers", " > "))


@query("h10_model_cards")
def _(lake):
    """Customer cards with the model's score and the model's drivers."""
    scores = model.score_all(lake.model(), lake.training())
    cards = lookup.customer_cards(lake.features(), scores, lake.drivers(), "mean_abs_contribution")
    return cards.withColumn("why_top_drivers", F.array_join("why_top_drivers", " > "))


# --- Business questions --------------------------------------------------------------


@query("q01_revenue_by_category_this_year")
def _(lake):
    return questions.revenue_by_category(lake.items(), this_year=True)


@query("q02_high_versus_low")
def _(lake):
    return questions.segment_comparison(lake.c360())


@query("q03_monthly_revenue_of_category")
def _(lake):
    return questions.monthly_revenue(lake.items(), "LARGE")


@query("q04_state_with_most_high")
def _(lake):
    return questions.most_high_state(lake.c360())


@query("q05_order_value_of_diamond_buyers")
def _(lake):
    return questions.order_value_by_diamond_buyer(lake.orders(), lake.items())


@query("q06_top_customers_by_propensity")
def _(lake):
    return questions.top_customers(lake.c360())


@query("q07_top_decile_revenue_share")
def _(lake):
    return questions.top_decile_revenue_share(lake.c360())


@query("q08_unit_price_of_categories")
def _(lake):
    return questions.unit_price_of(lake.items(), ["ECONOMY", "LARGE", "SMALL"])
