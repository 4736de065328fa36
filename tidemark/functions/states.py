"""Business states derived from one row: engagement, segment, offer, affinity flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, names and offer texts.
ACTIVE_DAYS = 14
COOLING_DAYS = 45
HIGH_DECILE = 9
MEDIUM_DECILE = 5
OCCASION_DAYS = 30
DIAMOND_SHARE = 0.6
CART_ADDS = 3
OFFER_ANNIVERSARY = "Anniversary: 40% off making charges on diamond sets"
OFFER_DIAMOND = "Diamond loyalty: complimentary certification + 25% off making"
OFFER_VIP = "VIP early access to new collection + free resizing"
OFFER_CART = "Cart nudge: 5% off cart above Rs.1L"
OFFER_WELCOME = "Welcome-back: 3% off next purchase"


def engagement_state(recency_days: Column) -> Column:
    return (
        F.when(recency_days <= ACTIVE_DAYS, "Active")
        .when(recency_days <= COOLING_DAYS, "Cooling")
        .otherwise("Dormant")
    )


def segment(decile: Column) -> Column:
    return F.when(decile >= HIGH_DECILE, "High").when(decile >= MEDIUM_DECILE, "Medium").otherwise("Low")


def near_occasion(days_to_anniversary: Column) -> Column:
    return days_to_anniversary <= OCCASION_DAYS


def diamond_buyer(diamond_share: Column) -> Column:
    return diamond_share >= DIAMOND_SHARE


def recommended_offer(
    days_to_anniversary: Column, diamond_share: Column, segment_name: Column, cart_adds: Column
) -> Column:
    """First matching rule of the decision list."""
    rules = [
        (near_occasion(days_to_anniversary), OFFER_ANNIVERSARY),
        (diamond_buyer(diamond_share), OFFER_DIAMOND),
        (segment_name == "High", OFFER_VIP),
        (cart_adds >= CART_ADDS, OFFER_CART),
    ]
    return F.coalesce(*[F.when(test, F.lit(text)) for test, text in rules], F.lit(OFFER_WELCOME))


def offer_rationale(
    segment_name: Column, score: Column, diamond_share: Column, days_to_anniversary: Column
) -> Column:
    """Text behind the offer; NULL when any part is NULL."""
    parts = {
        "segment": segment_name,
        "propensity": F.round(score, 3),
        "diamond_share": F.round(diamond_share.cast("decimal(10,4)"), 2),
        "days_to_anniversary": days_to_anniversary,
    }
    labelled = [F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in parts.items()]
    joined = [labelled[0]]
    for piece in labelled[1:]:
        joined += [F.lit(", "), piece]
    return F.concat(*joined)


def names_material(material: Column, word: str) -> Column:
    """Whether the material names ``word`` in any case; NULL for no material."""
    return F.contains(F.lower(material), F.lit(word))
