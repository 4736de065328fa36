from tidemark.plans import governance


def rows(df):
    return {r.user_id: r for r in df.collect()}


def test_masks_and_filter(lake):
    dimension = governance.customer_dimension(lake.users())
    everything = rows(dimension)
    assert rows(governance.governed_customers(dimension, ["admins", "staff"])) == everything
    visible = rows(governance.governed_customers(dimension, ["staff"]))
    assert set(visible) == {u for u, r in everything.items() if r.region == "South"}
    for user, row in visible.items():
        clear = everything[user]
        if clear.email is None:
            assert row.email is None
        else:
            tail = "@" + clear.email.split("@", 1)[1] if "@" in clear.email else ""
            assert row.email == clear.email[:2] + "***" + tail
        assert row.mobile == "******" + clear.mobile[-4:]


def test_regions(lake):
    for portable in (True, False):
        dimension = governance.customer_dimension(lake.users(), portable)
        assert {r.region for r in dimension.select("region").distinct().collect()} == set(governance.REGIONS)


def test_sql_masks_equal_column_masks(lake, spark):
    dimension = governance.customer_dimension(lake.users())
    for groups in (["admins"], []):
        governance.register_sql_masks(spark, groups)
        by_sql = dimension.where("region_filter(region)").selectExpr(
            "user_id", "mask_email(email) AS email", "mask_mobile(mobile) AS mobile"
        )
        by_column = governance.governed_customers(dimension, groups).select("user_id", "email", "mobile")
        assert by_sql.exceptAll(by_column).count() == 0 and by_sql.count() == by_column.count()
