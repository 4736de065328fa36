"""Requests to the lookup functions as they arrive: a function's name and JSON arguments.

Every request is parsed by its function's parameters and routed to the batch form of that
function; answers come back as rows with typed columns, faults as rows with their reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import lookup_join
from tidemark.plans import lookup
from tidemark.plans.search import SearchIndex, search_products_asked
from tidemark.session import write_and_read

# The functions and their parameters.
PARAMETERS = {
    "get_customer_propensity": {"p_user_id": "int"},
    "get_customer_profile": {"p_user_id": "int"},
    "recommend_next_best_offer": {"p_user_id": "int"},
    "get_top_prospects": {"p_segment": "string", "p_limit": "int"},
    "search_products": {"p_query": "string"},
    "get_category_performance": {"p_category": "string"},
}
_BY_USER = [fn for fn, names in PARAMETERS.items() if "p_user_id" in names]


def parse_requests(requests: DataFrame) -> DataFrame:
    """(request_id, fn, arguments) with the typed parameters and ``fault``, NULL if sound.

    Empty arguments are an empty object. A whole number may come as a number or as text.
    Parameters that a function does not have are passed over. Of several faults the first
    counts: an unknown function, text that is no JSON object, then the parameters in order.
    """
    text = F.when(F.trim(F.coalesce("arguments", F.lit(""))) == "", "{}").otherwise(F.col("arguments"))
    rows = requests.withColumn("__given", F.from_json(text, "map<string,string>"))
    kinds = {name: kind for names in PARAMETERS.values() for name, kind in names.items()}
    typed = {name: F.col("__given").getItem(name).try_cast(kind) for name, kind in kinds.items()}
    faults = []
    for fn, names in PARAMETERS.items():
        for name in names:
            given = F.col("__given").getItem(name)
            wrong = F.when(given.isNull(), f"missing {name}").when(typed[name].isNull(), f"bad {name}")
            faults.append(F.when(F.col("fn") == fn, wrong))
    known = F.coalesce(F.col("fn").isin(list(PARAMETERS)), F.lit(False))
    fault = F.coalesce(
        F.when(~known, "unknown function"), F.when(F.col("__given").isNull(), "bad JSON"), *faults
    )
    return rows.withColumns({**typed, "fault": fault}).drop("__given", "arguments")


def _of(rows: DataFrame, fns: list[str]) -> DataFrame:
    return rows.where(F.col("fault").isNull() & F.col("fn").isin(fns))


def _prospects(asked: DataFrame, scores: DataFrame) -> DataFrame:
    """One row for each place asked for that the segment has."""
    sizes = scores.groupBy(F.col("segment").alias("p_segment")).agg(F.count(F.lit(1)).alias("__size"))
    sized = lookup_join(asked.select("request_id", "fn", "p_segment", "p_limit"), sizes, "p_segment")
    last = F.least("p_limit", F.coalesce(F.col("__size"), F.lit(0))).cast("int")
    placed = sized.withColumn("place", F.explode_outer(F.when(last > 0, F.sequence(F.lit(1), last))))
    wanted = asked.groupBy(F.col("p_segment").alias("segment")).agg(F.max("p_limit").alias("n"))
    best = lookup.top_prospects_asked(scores, wanted)
    best = best.select(
        F.struct("segment", F.col("place").cast("int").alias("place")).alias("__spot"), "user_id", "propensity_score"
    )
    spot = F.struct(F.col("p_segment").alias("segment"), "place")
    found = lookup_join(placed.withColumn("__spot", F.when(F.col("place").isNotNull(), spot)), best, "__spot")
    return found.select("request_id", "fn", "place", "user_id", "propensity_score")


def _products(asked: DataFrame, products: DataFrame, index: SearchIndex | None) -> DataFrame:
    """One row for each product found; the hits of one query are eight at most."""
    asked = asked.select("request_id", "fn", F.col("p_query").alias("query"))
    hits = search_products_asked(products, asked, index=index)
    held = ["place", *[c for c in hits.columns if c not in ("query", "place")]]
    answers = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(*held))).alias("__hits"))
    rows = lookup_join(asked, answers, "query").withColumn("__hit", F.explode_outer("__hits"))
    return rows.select("request_id", "fn", "__hit.*")


def answer_requests(
    requests: DataFrame,
    features: DataFrame,
    scores: DataFrame,
    products: DataFrame,
    category_kpis: DataFrame,
    index: SearchIndex | None = None,
) -> DataFrame:
    """Answers to requests (request_id, fn, arguments as JSON text) of all six functions.

    Every request has at least one row: ``status`` is ``ok`` with ``place`` from 1, ``no
    rows``, or the fault. Each row has the columns of its function, the others NULL. A
    customer, segment, query or category may be asked for in any share of the requests.
    """
    parsed = write_and_read(parse_requests(requests), "requests")
    by_user = _of(parsed, _BY_USER).select("request_id", "fn", F.col("p_user_id").alias("user_id"))
    one = F.lit(1)
    customers = lookup.answer_requests(by_user, features, scores).withColumn("place", F.when(F.col("found"), one))
    categories = lookup_join(
        _of(parsed, ["get_category_performance"]).select("request_id", "fn", F.col("p_category").alias("category")),
        lookup.category_performance(category_kpis).withColumn("place", one),
        "category",
    )
    parts = [
        customers.drop("found"),
        _prospects(_of(parsed, ["get_top_prospects"]), scores),
        _products(_of(parsed, ["search_products"]), products, index),
        categories,
        parsed.where("fault IS NOT NULL").select("request_id", "fn", F.col("fault").alias("status")),
    ]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    status = F.coalesce("status", F.when(F.col("place").isNull(), "no rows").otherwise("ok"))
    first = ["request_id", "fn", "status", "place"]
    return whole.withColumn("status", status).select(*first, *[c for c in whole.columns if c not in first])

