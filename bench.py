"""Seconds per headline query; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query's result
is computed in full and thrown away. ``build_tables`` derives all written tables (joined
items, features, training set, scores) from the source files, from nothing, each time;
the other queries read the tables written before, as the jobs do in use; ``fit_model``
fits and stores the model that the model queries read. Quick queries
are warmed once and timed three times (median); the slow ones listed in ``ONCE`` are
timed once.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.plans.catalog import QUERIES
from tidemark.plans.lakehouse import Lakehouse, open_lakehouse
from tidemark.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "b01_expectation_counts",
    "b02_batch_clean",
    "b03_quarantine_safe",
    "b04_silver_projection",
    "b07_row_filter_analyst",
    "b11_next_best_offer",
    "b12_propensity_lookup",
    "b13_profile_lookup",
    "b14_category_lookup",
    "b15_search_products",
    "b15_search_many",
    "b15_search_index",
    "b16_golden_cohort",
    "b17_guard_documents",
    "c03_feature_star",
    "c04_customer_360",
    "c07_answer_requests",
    "c07_json_requests",
    "d02_order_features",
    "d03_item_features",
    "d06_occasion_features",
    "d08_sales_by_category_month",
    "d10_daily_sales_kpi",
    "d12_propensity_measures",
    "d16_sync_check",
    "d18_feature_profile",
    "d19_usage_per_user_day",
    "e01_top_prospects_by_segment",
    "e03_decile",
    "e04_average_precision",
    "e05_roc_auc",
    "e07_precision_at_decile",
    "h05_latent_propensity",
    "h06_training_dataset",
    "h07_stratified_split",
    "h09_term_contributions",
    "h10_customer_cards",
    "q01_revenue_by_category_this_year",
    "q03_monthly_revenue_of_category",
    "q05_order_value_of_diamond_buyers",
    "q06_top_customers_by_propensity",
    "q07_top_decile_revenue_share",
    "r01_user_calls_per_minute",
    "r01_rolling_user_limit",
]
ONCE = [
    "a01_ingest_orders",
    "a04_stream_silver",
    "a08_gold_refresh",
    "a08_gold_merged",
    "a09_upsert_scores",
    "r01_stream_users_over_daily_limit",
    "h03_model_scores",
    "h08_model_metrics",
    "h09_model_contributions",
    "h10_model_cards",
]
REPEATS = 3


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        {
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> None:
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()

    def build_tables() -> None:
        Lakehouse(spark, FOLDER).scores()

    build_tables()
    timed = {"build_tables": statistics.median(seconds(build_tables) for _ in range(REPEATS))}
    for name in HEADLINE:
        run(name)
        timed[name] = statistics.median(seconds(lambda: run(name)) for _ in range(REPEATS))
    timed["fit_model"] = seconds(lambda: open_lakehouse(spark, FOLDER).model())
    for name in ONCE:
        timed[name] = seconds(lambda: run(name))
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": {name: round(value, 3) for name, value in timed.items()},
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
