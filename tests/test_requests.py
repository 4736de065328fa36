from decimal import Decimal

import pytest

from tidemark.plans import lookup, requests, search

SHAPE = "request_id int, fn string, arguments string"


def plain(value):
    return float(value) if isinstance(value, Decimal) else value


@pytest.fixture(scope="module")
def answered(lake, spark):
    def answer(rows):
        asked = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SHAPE)
        found = requests.answer_requests(
            asked, lake.features(), lake.scores(), lake.products(), lake.category_kpis(), lake.search_index()
        )
        return sorted(found.collect(), key=lambda r: (r.request_id, r.place or 0))

    return answer


def test_faults(spark):
    cases = [
        ("get_customer_propensity", '{"p_user_id": 7}', None),
        ("get_customer_propensity", '{"p_user_id": "7", "more": [1]}', None),
        ("get_customer_propensity", '{"p_user_id": 7.5}', "bad p_user_id"),
        ("get_customer_propensity", '{"p_user_id": 99999999999}', "bad p_user_id"),
        ("get_customer_propensity", '{"p_user_id": null}', "missing p_user_id"),
        ("get_customer_propensity", '{"P_USER_ID": 7}', "missing p_user_id"),
        ("get_customer_propensity", None, "missing p_user_id"),
        ("get_customer_propensity", "  ", "missing p_user_id"),
        ("get_customer_propensity", "[7]", "bad JSON"),
        ("get_customer_propensity", '{"p_user_id"', "bad JSON"),
        ("get_top_prospects", '{"p_limit": 3}', "missing p_segment"),
        ("get_top_prospects", '{"p_segment": "High", "p_limit": "x"}', "bad p_limit"),
        ("search_products", '{"p_query": 5}', None),
        ("search_products", '{"p_query": ""}', None),
        ("drop_everything", "{", "unknown function"),
        (None, "{}", "unknown function"),
    ]
    rows = spark.createDataFrame([(i, fn, text) for i, (fn, text, _) in enumerate(cases)], SHAPE)
    found = requests.parse_requests(rows).orderBy("request_id").collect()
    assert [r.fault for r in found] == [fault for _, _, fault in cases]
    assert found[1].p_user_id == 7 and found[12].p_query == "5"


def test_answers_equal_single_calls(lake, answered):
    user = lake.scores().orderBy("user_id").first().user_id
    rows = answered(
        [
            ("get_customer_propensity", f'{{"p_user_id": {user}}}'),
            ("get_customer_profile", f'{{"p_user_id": "{user}"}}'),
            ("recommend_next_best_offer", f'{{"p_user_id": {user}}}'),
            ("get_top_prospects", '{"p_segment": "High", "p_limit": 5}'),
            ("search_products", '{"p_query": "ring"}'),
            ("get_category_performance", '{"p_category": "LARGE"}'),
            ("get_customer_profile", '{"p_user_id": -1}'),
            ("get_top_prospects", '{"p_segment": "High", "p_limit": 0}'),
            ("get_top_prospects", '{"p_segment": "Odd", "p_limit": 3}'),
            ("get_top_prospects", '{"p_segment": "Low", "p_limit": 2000000000}'),
            ("search_products", '{"p_query": "no such thing"}'),
        ]
    )
    by_request = {i: [r for r in rows if r.request_id == i] for i in range(11)}
    singles = [
        lookup.customer_propensity(lake.scores(), user),
        lookup.customer_profile(lake.features(), user),
        lookup.next_best_offer(lake.scores(), lake.features(), user),
        lookup.top_prospects(lake.scores(), "High", 5),
        search.search_products(lake.products(), "ring"),
        lookup.category_performance(lake.category_kpis(), "LARGE"),
    ]
    for i, single in enumerate(singles):
        wanted = single.collect()
        got = [tuple(plain(r[c]) for c in single.columns) for r in by_request[i]]
        assert got == [tuple(map(plain, r)) for r in wanted], i
        assert [r.place for r in by_request[i]] == list(range(1, len(wanted) + 1))
    for i in (6, 7, 8, 10):
        assert [(r.status, r.place) for r in by_request[i]] == [("no rows", None)]
    assert len(by_request[9]) == lake.scores().where("segment = 'Low'").count()


def test_frequent_arguments(lake, answered):
    """Nearly all requests ask for one customer, segment or query."""
    user = lake.scores().orderBy("user_id").first().user_id
    rows = answered(
        [("get_customer_propensity", f'{{"p_user_id": {user}}}')] * 300
        + [("get_top_prospects", '{"p_segment": "High", "p_limit": 2}')] * 300
        + [("search_products", '{"p_query": "ring"}')] * 300
    )
    assert [sum(r.request_id // 300 == k for r in rows) for k in range(3)] == [300, 600, 2400]
    assert len({(r.user_id, r.propensity_score) for r in rows if r.request_id < 300}) == 1
