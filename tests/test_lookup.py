import re

import pytest
from pyspark.sql import functions as F

from tidemark.plans import lookup, search
from tidemark.sources import retail


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_lookups_of_one_customer(lake):
    user = lake.scores().agg(F.min("user_id")).first()[0]
    score = one(lookup.customer_propensity(lake.scores(), user))
    profile = one(lookup.customer_profile(lake.features(), user))
    offer = one(lookup.next_best_offer(lake.scores(), lake.features(), user))
    assert score.propensity_score == offer.propensity_score
    assert f"segment={score.segment}, " in offer.rationale
    assert offer.rationale.endswith(f"days_to_anniversary={profile.days_to_anniversary}")
    assert lookup.customer_propensity(lake.scores(), -1).count() == 0
    assert lookup.next_best_offer(lake.scores(), lake.features(), -1).count() == 0


def test_missing_part_empties_the_rationale(spark):
    scores = spark.createDataFrame([(1, 0.5, None, 3)], "user_id int, propensity_score double, segment string, decile int")
    features = spark.createDataFrame(
        [(1, 0.25, 0, 40)], "user_id int, diamond_share double, cart_adds bigint, days_to_anniversary int"
    )
    row = one(lookup.next_best_offer(scores, features))
    assert row.rationale is None and row.recommended_offer.startswith("Welcome-back")


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        ("A", "100% gold ring", "RING", None, 5, "plain", "x"),
        ("B", "Diamond_ring", "RING", "Gold", 9, None, None),
        ("C", "bangle", "BANGLE", "Gold", 9, "for a RING finger", "y"),
    ]
    return spark.createDataFrame(
        rows, "product_id string, name string, category string, material string, price_inr int, description string, tags string"
    )


def found(df):
    return [r.product_id for r in df.collect()]


def test_search(products):
    assert found(search.search_products(products, "ring")) == ["B", "C", "A"]
    assert found(search.search_products(products, "RING", n=1)) == ["B"]
    assert found(search.search_products(products, "100%g")) == ["A"]
    assert found(search.search_products(products, "100%g", literal=True)) == []
    assert found(search.search_products(products, "d_r", literal=True)) == ["B"]
    assert found(search.search_products(products, None)) == []


def test_many_searches_equal_single_ones(lake):
    texts = ["ring", "r%g", "small", "SMALL", "none of it"]
    many = search.search_products_many(lake.products(), texts).collect()
    for text in texts:
        single = found(search.search_products(lake.products(), text))
        batch = sorted((r.place, r.product_id) for r in many if r["query"] == text)
        assert [p for _, p in batch] == single


def test_batch_answers_equal_single_lookups(lake, spark, folder):
    answers = lookup.answer_requests(retail.requests(spark, folder), lake.features(), lake.scores()).collect()
    assert {r.found for r in answers} == {True, False}
    scores = {r.user_id: r for r in lookup.customer_propensity(lake.scores()).collect()}
    offers = {r.user_id: r for r in lookup.next_best_offer(lake.scores(), lake.features()).collect()}
    for row in answers:
        assert row.found == (row.user_id in scores)
        if row.found and row.fn == "get_customer_propensity":
            assert row.propensity_score == scores[row.user_id].propensity_score
            assert row.rationale is None
        if row.found and row.fn == "recommend_next_best_offer":
            assert row.recommended_offer == offers[row.user_id].recommended_offer
            assert row.segment is None


def test_sql_functions_equal_dataframe_functions(lake, spark):
    lookup.register_sql_functions(spark, lake.features(), lake.scores(), lake.products(), lake.category_kpis())
    user = lake.scores().agg(F.max("user_id")).first()[0]
    pairs = [
        (f"get_customer_propensity({user})", lookup.customer_propensity(lake.scores(), user)),
        (f"get_customer_profile({user})", lookup.customer_profile(lake.features(), user)),
        (f"recommend_next_best_offer({user})", lookup.next_best_offer(lake.scores(), lake.features(), user)),
        ("get_top_prospects('Low', 3)", lookup.top_prospects(lake.scores(), "Low", 3)),
        ("search_products('ring')", search.search_products(lake.products(), "ring")),
        ("get_category_performance('LARGE')", lookup.category_performance(lake.category_kpis(), "LARGE")),
    ]
    for call, df in pairs:
        got = spark.sql(f"SELECT {', '.join(df.columns)} FROM {call}").collect()
        assert got == df.collect(), call
        assert got


def test_searches_as_a_table_equal_single_searches(spark, lake):
    texts = ["ring", "r%g", "_", "%", "", "small", "50%", "nothing like it", "SM"]
    for literal in (False, True):
        searches = spark.createDataFrame([(t,) for t in [*texts, "ring", None]], "query string")
        rows = search.search_products_asked(lake.products(), searches, literal=literal).collect()
        for text in texts:
            one = search.search_products(lake.products(), text, literal=literal).collect()
            got = [r for r in rows if r.query == text]
            assert [r.product_id for r in sorted(got, key=lambda r: r.place)] == [r.product_id for r in one], text


def test_searches_as_a_table_join_by_key(lake, spark):
    searches = spark.createDataFrame([("ring",)], "query string")
    plan = search.search_products_asked(lake.products(), searches)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


HARD = [
    "10\\%", "100\\%", "100%", "d\\_r", "d_r", "\\", "\\\\", "b\\s", "b\\\\s", "\\%", "\\_", "a%\\_", "", "%", "_",
    "____________", "_____________", "r", "Ri", "r%g", "r_n", "RING", "zz", "\n", "x\ny", "%%__", "öl", "ÖL", "ring finger",
]


@pytest.fixture(scope="module")
def awkward_products(spark):
    rows = [
        ("A", "100% gold ring", "RING", None, 5, "plain", "x"),
        ("B", "Diamond_ring", "RING", "Gold", 9, None, None),
        ("C", "bangle", "BANGLE", "Gold", 9, "for a RING finger", "y"),
        ("D", "b\\s", "X", None, 1, "10", "50\\%"),
        ("E", None, None, None, None, None, None),
        ("F", "", None, None, 3, "", ""),
        ("G", "Öl", "X", None, 7, "x", "y"),
        ("H", "long " * 5000, "X", None, 2, None, "zz"),
    ]
    return spark.createDataFrame(
        rows, "product_id string, name string, category string, material string, price_inr int, description string, tags string"
    )


def plain_search(rows, query):
    """By a regular expression made sign by sign."""
    pattern, i = "", 0
    while i < len(query):
        if query[i] == "\\" and query[i + 1 : i + 2] in ("%", "_", "\\") and query[i + 1 : i + 2]:
            i += 1
            pattern += re.escape(query[i].lower())
        else:
            pattern += {"%": ".*", "_": "."}.get(query[i], re.escape(query[i].lower()))
        i += 1
    hits = [r for r in rows if any(v is not None and re.search(pattern, v.lower(), re.S) for v in (r.name, r.description, r.tags))]
    hits.sort(key=lambda r: (-(r.price_inr if r.price_inr is not None else -1), r.product_id))
    return [r.product_id for r in hits[:8]]


def test_escapes_and_hard_searches(spark, awkward_products):
    rows = awkward_products.collect()
    searches = spark.createDataFrame([(t,) for t in HARD], "query string")
    asked = search.search_products_asked(awkward_products, searches).collect()
    many = search.search_products_many(awkward_products, HARD).collect()
    lookup.register_sql_functions(spark, *[spark.createDataFrame([], s) for s in (
        "user_id int, recency_days int, frequency bigint, monetary_total double, aov double, diamond_share double,"
        " wishlist_count bigint, cart_adds bigint, days_to_anniversary int",
        "user_id int, propensity_score double, segment string, decile int",
    )], awkward_products, spark.createDataFrame([], "category string, units bigint, revenue bigint, avg_unit_price bigint, diamond_mix double"))
    for text in HARD:
        wanted = plain_search(rows, text)
        for found_rows in (asked, many):
            got = sorted((r.place, r.product_id) for r in found_rows if r["query"] == text)
            assert [p for _, p in got] == wanted, text
        assert found(search.search_products(awkward_products, text)) == wanted, text
        call = spark.sql("SELECT product_id FROM search_products(:q)", {"q": text})
        assert found(call) == wanted, text


def test_a_common_trigram_costs_nothing(spark):
    """All products hold "common"; a query with a rare word too meets only that one's products."""
    rows = [(f"p{i:04}", f"common thing {'rare' if i % 400 == 0 else i}", "c", "m", i, None, None) for i in range(2000)]
    products = spark.createDataFrame(
        rows, "product_id string, name string, category string, material string, price_inr int, description string, tags string"
    )
    index = search.build_index(products)
    asked = search._asked(spark.createDataFrame([("common%rare",), ("common zzz",)], "query string"), False)
    (chosen,) = search.rarest_grams(asked, index.grams).collect()
    assert chosen["query"] == "common%rare"
    assert index.postings.where(F.col("gram") == chosen.gram).count() == 5
    result = search.search_products_asked(products, spark.createDataFrame([("common%rare",)], "query string"), index=index)
    assert [r.product_id for r in sorted(result.collect(), key=lambda r: r.place)] == ["p1600", "p1200", "p0800", "p0400", "p0000"]
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_asked_prospects_equal_single_calls(spark, lake):
    asks = spark.createDataFrame([("High", 3), ("Low", 7), ("High", 5), ("None", 2)], "segment string, n int")
    rows = lookup.top_prospects_asked(lake.scores(), asks).collect()
    for segment, n in (("High", 5), ("Low", 7)):
        got = sorted((r for r in rows if r.segment == segment), key=lambda r: r.place)
        one = lookup.top_prospects(lake.scores(), segment, n).collect()
        assert [r.user_id for r in got] == [r.user_id for r in one]
    assert len(rows) == 12


def broadcast_parts(df):
    """The subtrees of a plan, as text, that are sent to every task."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


@pytest.mark.parametrize("literal", [False, True])
def test_rows_by_trigram_are_never_broadcast(lake, monkeypatch, literal):
    products = lake.products()
    texts = ["ring", "r%g", "sm", "b", "nothing like it", "%", ""]
    wanted = F.get(F.array(*map(F.lit, texts)), F.pmod(F.xxhash64("product_id"), F.lit(len(texts))).cast("int"))
    asked = products.select(wanted.alias("query"))
    found = []
    for few in (search._FEW_SIGNS, 0):
        monkeypatch.setattr(search, "_FEW_SIGNS", few)
        hits = search.search_products_asked(products, asked, literal=literal)
        assert not [p for p in broadcast_parts(hits) if "Generate" in p and "p_name" in p]
        found.append(sorted(hits.collect()))
    assert found[0] == found[1] != []
