"""The work of a SQL user on the named views."""

import pytest

from tidemark.plans.views import named_views, register_views
from tidemark.streaming.ingest import inferred_schema

STATEMENTS = [
    "SELECT max(user_id) FROM customer_features",
    "SELECT decile, min(propensity_score) AS least, max(propensity_score) AS most FROM customer_nbo_scores"
    " GROUP BY decile ORDER BY decile",
    "SELECT * FROM get_top_prospects('Medium', 3)",
    "SELECT year(order_date) AS sold, material, sum(quantity) AS pieces FROM fact_order_items GROUP BY ALL",
    "SELECT mask_email('someone@mail.example'), mask_mobile('9000000001')",
    "SELECT o.recommended_offer, count(*) FROM customer_360 AS c,"
    " LATERAL recommend_next_best_offer(c.user_id) AS o GROUP BY 1",
]


@pytest.fixture(scope="module", autouse=True)
def views(lake):
    register_views(lake)


@pytest.mark.parametrize("text", STATEMENTS)
def test_statement(spark, text):
    assert spark.sql(text).count() > 0


def test_every_view_has_rows(spark, lake):
    for name in named_views(lake):
        assert not spark.table(name).isEmpty(), name


def test_customers_are_governed_by_group(spark, lake):
    assert {r.region for r in spark.table("dim_customers").collect()} == {"South"}
    register_views(lake, ["admins"])
    assert spark.table("dim_customers").count() == lake.users().count()
    register_views(lake)


def test_inferred_schema(spark, lake, tmp_path):
    lake.orders_raw().write.json(str(tmp_path / "landing"))
    fields = set(inferred_schema(spark, str(tmp_path / "landing"), 1.0).fieldNames())
    assert {"order_id", "user_id", "total_amount", "status", "order_date"} <= fields
