"""Named views and SQL functions over the tables, for work in SQL."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame

from tidemark.operators import quality
from tidemark.plans import governance, kpis, lookup
from tidemark.plans.lakehouse import Lakehouse


def named_views(lake: Lakehouse, groups: Collection[str] = ()) -> dict[str, DataFrame]:
    """Every table a SQL user may name; customers appear as ``groups`` may see them."""
    rules = quality.order_rules()
    dimension = governance.customer_dimension(lake.users())
    # A lakehouse on known propensities has no model, and fits none for a view.
    drivers = {"nbo_model_drivers": lake.drivers()} if lake.scorer == "model" else {}
    return drivers | {
        "fact_orders": lake.orders(),
        "fact_order_items": lake.items(),
        "fact_carts": lake.carts(),
        "fact_wishlists": lake.wishlists(),
        "products": lake.products(),
        "orders_clean": quality.clean(lake.orders_raw(), rules),
        "orders_quarantine": quality.quarantine(lake.orders_raw(), rules),
        "dim_customers": governance.governed_customers(dimension, groups),
        "customer_features": lake.features(),
        "training_dataset": lake.training(),
        "customer_nbo_scores": lake.scores(),
        "customer_360": lake.c360(),
        "kpi_daily_sales": kpis.daily_sales_kpi(lake.orders(), lake.items()),
        "kpi_category_performance": lake.category_kpis(),
        "kpi_customer_value": kpis.customer_value_kpi(lake.features()),
        "nbo_segment_summary": kpis.segment_summary(lake.scores()),
    }


def register_views(lake: Lakehouse, groups: Collection[str] = ()) -> None:
    """Temporary views, masks and lookup functions for the session of the lakehouse."""
    for name, df in named_views(lake, groups).items():
        df.createOrReplaceTempView(name)
    governance.register_sql_masks(lake.spark, groups)
    lookup.register_sql_functions(
        lake.spark, lake.features(), lake.scores(), lake.products(), lake.category_kpis()
    )
