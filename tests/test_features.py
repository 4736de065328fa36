from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.plans.features import customer_features


def test_pipeline_form_shares_its_columns_with_the_full_form(lake):
    full = lake.features()
    short = customer_features(lake.orders(), lake.items(), lake.users())
    assert len(full.columns) == 19 and len(short.columns) == 14
    assert full.select(*short.columns).exceptAll(short).count() == 0
    assert full.count() == short.count()


def test_customer_without_orders_is_absent_and_defaults_are_filled(spark):
    orders = spark.createDataFrame(
        [(1, 7, Decimal("10.00"), date(2001, 1, 1), 2), (1, 7, Decimal("10.00"), date(2001, 1, 1), 2)],
        "order_id bigint, user_id int, total_amount decimal(18,2), order_date date, item_count bigint",
    )
    items = spark.createDataFrame([], "user_id int, category string, material string")
    users = spark.createDataFrame(
        [(8, None, None, None)],
        "user_id int, anniversary_date date, date_of_birth date, milestone_date date",
    )
    engaged = spark.createDataFrame([], "user_id int, price_inr decimal(18,2)")
    rows = customer_features(orders, items, users, engaged, engaged).collect()
    assert [r.user_id for r in rows] == [7]
    row = rows[0]
    assert (row.frequency, row.monetary_total, row.recency_days) == (1, Decimal("20.00"), 0)
    assert (row.total_items, row.cart_adds, row.diamond_share, row.has_milestone) == (0, 0, 0.0, 0)
    assert (row.days_to_anniversary, row.days_to_birthday) == (365, 365)


def test_one_customer_with_a_third_of_all_orders(spark):
    heavy = spark.range(9000).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") % 500) + 2).cast("int").alias("user_id"),
        F.lit(Decimal("2.50")).cast("decimal(18,2)").alias("total_amount"),
        F.to_date(F.lit("2001-01-01")).alias("order_date"),
        F.lit(1).cast("bigint").alias("item_count"),
    )
    items = heavy.select("user_id", F.lit("RING").alias("category"), F.lit("Diamond").alias("material"))
    users = spark.createDataFrame(
        [(1, date(1990, 1, 2), None, None)],
        "user_id int, anniversary_date date, date_of_birth date, milestone_date date",
    )
    df = customer_features(heavy, items, users)
    one = df.where("user_id = 1").first()
    assert (one.frequency, one.monetary_total, one.total_items, one.diamond_share) == (3000, Decimal("7500.00"), 3000, 1.0)
    assert one.days_to_anniversary == 1
    assert df.agg(F.sum("frequency")).first()[0] == 9000


def test_item_revenue_by_category_adds_up(lake):
    from tidemark.plans.kpis import sales_view

    view = sales_view(lake.items())
    whole = view.query(["revenue"]).first().revenue
    parts = view.query(["revenue"], by=["category"]).agg(F.sum("revenue")).first()[0]
    assert whole == parts == lake.items().agg(F.sum("line_total")).first()[0]


def test_lifetime_value_adds_up(lake):
    from tidemark.plans.kpis import propensity_view

    row = propensity_view(lake.c360()).query(["customers", "avg_lifetime_value", "avg_propensity"]).first()
    revenue = lake.orders().agg(F.sum("total_amount")).first()[0]
    assert abs(row.avg_lifetime_value * row.customers - float(revenue)) < 0.01
    by_segment = propensity_view(lake.c360()).query(["customers", "avg_propensity"], by=["segment"]).collect()
    weighted = sum(r.customers * r.avg_propensity for r in by_segment) / row.customers
    assert abs(weighted - row.avg_propensity) < 1e-9


def test_every_branch_occurs_in_the_fixture(lake):
    from tidemark.functions.states import engagement_state
    from tidemark.plans import lookup

    offers = lookup.next_best_offer(lake.scores(), lake.features())
    assert offers.select("recommended_offer").distinct().count() == 5
    assert lake.scores().select("segment").distinct().count() == 3
    states = lake.features().select(engagement_state(F.col("recency_days"))).distinct()
    assert states.count() == 3
