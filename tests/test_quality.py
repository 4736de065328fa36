import itertools
from decimal import Decimal

import pytest

from tidemark.operators import quality
from tidemark.sources.retail import ORDERS_RAW_SCHEMA


@pytest.fixture(scope="module")
def patterns(spark):
    """All combinations of good, missing and (for the amount) bad values of the five columns."""
    rows = []
    amounts = [Decimal("5.00"), Decimal("0.00"), Decimal("-1.00"), None]
    for amount, user, order, status, day in itertools.product(
        amounts, [7, None], [1, None], ["O", None], ["2001-02-03", "garbage", None]
    ):
        rows.append((order, user, amount, status, day, 1, "2001-02-03"))
    return spark.createDataFrame(rows, ORDERS_RAW_SCHEMA)


def test_split_is_complete(patterns):
    rules = quality.order_rules()
    clean = quality.clean(patterns, rules)
    held = quality.quarantine(patterns, rules)
    assert clean.count() + held.count() == patterns.count()
    assert clean.exceptAll(held.drop("dq_reason")).count() == clean.count()


def test_reference_split_loses_rows_with_unknown_outcome(patterns):
    rules = quality.order_rules()
    held = quality.quarantine(patterns, rules, mode="reference")
    complete = quality.quarantine(patterns, rules)
    lost = complete.exceptAll(held).collect()
    # Only a missing amount with everything else present has an unknown outcome.
    assert {row.dq_reason for row in lost} == {"invalid_amount"}
    assert all(row.total_amount is None for row in lost)
    assert len(lost) == 2


def test_reasons_are_listed_in_rule_order(patterns):
    held = quality.quarantine(patterns, quality.order_rules())
    reasons = {row.dq_reason for row in held.collect()}
    assert "invalid_amount; null_user; null_order; null_status; null_date" in reasons
    assert "" not in reasons


def test_unreadable_date_never_fails(patterns):
    silver = quality.silver_orders(patterns)
    assert silver.where("order_date IS NOT NULL").count() == patterns.count() // 3
    rules = [*quality.order_rules(), quality.readable_date_rule()]
    reasons = {row.dq_reason for row in quality.quarantine(patterns, rules).collect()}
    assert "bad_date" in reasons


def test_counts_match_the_rules(patterns):
    counts = {r.rule: r.violations for r in quality.violation_counts(patterns, quality.order_rules()).collect()}
    total = patterns.count()
    assert counts == {
        "valid_amount": total * 3 // 4,
        "has_user": total // 2,
        "has_order": total // 2,
        "has_status": total // 2,
        "has_date": total // 3,
    }


def test_unknown_mode(patterns):
    with pytest.raises(ValueError):
        quality.quarantine(patterns, quality.order_rules(), mode="other")
