"""Standard scores, latent propensity, label draw, deciles, segments, split and drivers."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import murmur_bucket, portable_hash
from tidemark.functions.states import near_occasion, segment
from tidemark.operators.ordered import equal_frequency_bucket, global_rank, rank_in_group

# Weights of the latent logit.
INTERCEPT = -0.60
STANDARD_WEIGHTS = {
    "frequency": 0.70,
    "recency_days": -0.70,
    "monetary_total": 0.50,
    "wishlist_count": 0.50,
    "cart_adds": 0.40,
    "tenure_days": 0.20,
}
DIAMOND_WEIGHT = 1.20
DIAMOND_CENTRE = 0.4
OCCASION_WEIGHT = 0.80
DRAW_STEPS = 100000

KEY = "user_id"
LABEL = "label_conversion"
LABEL_VALUES = [0, 1]
TRUE_PROPENSITY = "propensity_true"
# Names of the features, in the order of the table.
FEATURES = [
    "recency_days",
    "tenure_days",
    "frequency",
    "monetary_total",
    "aov",
    "avg_item_count",
    "total_items",
    "distinct_categories",
    "diamond_share",
    "gold_share",
    "cart_adds",
    "cart_value",
    "wishlist_count",
    "wishlist_value",
    "days_to_anniversary",
    "days_to_birthday",
    "has_milestone",
]

# Our own default; pass the seed of an existing data set to repeat its labels.
DEFAULT_SEED = "conversion-draw"


def _scaled_input(name: str) -> Column:
    """The quantity that is standardised: spend enters by its logarithm."""
    value = F.col(name).cast("double")
    return F.log(value + 1) if name == "monetary_total" else value


def feature_statistics(features: DataFrame) -> DataFrame:
    """One row with mean and sample deviation of the six standardised features."""
    parts = []
    for name in STANDARD_WEIGHTS:
        parts.append(F.avg(_scaled_input(name)).alias(f"{name}_mean"))
        parts.append(F.stddev_samp(_scaled_input(name)).alias(f"{name}_std"))
    return features.agg(*parts)


def standard_scores(features: DataFrame, null_as_zero: bool = False) -> DataFrame:
    """Add ``z_<feature>``; a constant feature gives NULL, or 0 with ``null_as_zero``.

    The statistics come from one aggregation and enter as one scalar subquery.
    """
    stats = feature_statistics(features)
    row = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    scores = {}
    for name in STANDARD_WEIGHTS:
        mean, std = F.col(f"__stats.{name}_mean"), F.col(f"__stats.{name}_std")
        z = (_scaled_input(name) - mean) / F.nullif(std, F.lit(0.0))
        scores[f"z_{name}"] = F.coalesce(z, F.lit(0.0)) if null_as_zero else z
    return features.withColumn("__stats", row).withColumns(scores).drop("__stats")


def latent_terms() -> dict[str, Column]:
    """The weighted terms of the logit, by the feature each one comes from."""
    terms = {name: weight * F.col(f"z_{name}") for name, weight in STANDARD_WEIGHTS.items()}
    terms["diamond_share"] = DIAMOND_WEIGHT * (F.col("diamond_share") - DIAMOND_CENTRE)
    terms["days_to_anniversary"] = OCCASION_WEIGHT * near_occasion(
        F.col("days_to_anniversary")
    ).cast("double")
    return terms


def latent_propensity(features: DataFrame, null_as_zero: bool = False) -> DataFrame:
    """Add the logit ``latent`` and its sigmoid ``propensity`` (unrounded)."""
    latent = reduce(add, latent_terms().values(), F.lit(INTERCEPT))
    return (
        standard_scores(features, null_as_zero)
        .withColumn("latent", latent)
        .withColumn("propensity", 1 / (1 + F.exp(-F.col("latent"))))
    )


def draw(key: Column, seed: str, portable: bool = False) -> Column:
    """Reproducible number in [0, 1) from the key: Murmur3, or md5 in the portable form."""
    if portable:
        step = portable_hash(key, F.lit(seed)) % DRAW_STEPS
    else:
        step = murmur_bucket(DRAW_STEPS, key, F.lit(seed))
    return step / float(DRAW_STEPS)


def training_dataset(
    features: DataFrame, seed: str = DEFAULT_SEED, portable: bool = False, null_as_zero: bool = False
) -> DataFrame:
    """Features, true propensity (6 digits) and a Bernoulli label.

    The draw is compared with the unrounded propensity; an unknown propensity gives 0.
    """
    hit = draw(F.col(KEY), seed, portable) < F.col("propensity")
    return latent_propensity(features, null_as_zero).select(
        KEY,
        *FEATURES,
        F.round("propensity", 6).alias(TRUE_PROPENSITY),
        F.coalesce(hit, F.lit(False)).cast("int").alias(LABEL),
    )


def model_features(training: DataFrame) -> list[str]:
    """Columns a model may see: never the key, the label or the true propensity."""
    hidden = {KEY, LABEL, TRUE_PROPENSITY}
    return [name for name in training.columns if name not in hidden]


def leakage_safe(training: DataFrame) -> DataFrame:
    return training.select(*model_features(training))


def numeric_features(training: DataFrame) -> DataFrame:
    """All model features as DOUBLE; a value that is no number becomes NULL."""
    names = model_features(training)
    return training.withColumns({name: F.col(name).try_cast("double") for name in names})


def score_table(scored: DataFrame, score: str) -> DataFrame:
    """Key, score, decile and segment of every customer.

    Ranks ascend by score, equal scores by key.
    """
    narrow = scored.select(KEY, F.col(score).alias("propensity_score"))
    ranked = global_rank(narrow, [F.col("propensity_score"), F.col(KEY)])
    decile = equal_frequency_bucket(F.col("rank"), F.col("total"))
    return ranked.withColumn("decile", decile).select(
        KEY, "propensity_score", "decile", segment(F.col("decile")).alias("segment")
    )


def stratified_split(
    training: DataFrame, train_percent: int = 75, seed: str = DEFAULT_SEED, portable: bool = False
) -> DataFrame:
    """Add ``is_train``: the first share of each label's rows in keyed-hash order.

    Each label keeps its share exactly (rounded down), and the same key always falls on
    the same place in the order. Only label, hash and key are ranked; the last place that
    belongs to each label's share comes back as one row, and the full rows are marked by
    comparing with it, without being moved.
    """
    if portable:
        place = portable_hash(F.col(KEY), F.lit(f"{seed}-split"))
    else:
        place = F.xxhash64(F.col(KEY), F.lit(f"{seed}-split"))
    spot = F.struct(place.alias("place"), F.col(KEY).alias("key"))
    narrow = training.select(LABEL, spot.alias("spot"))
    ranked = rank_in_group(narrow, LABEL, LABEL_VALUES, [F.col("spot")])
    inside = F.col("rank") <= F.floor(F.col("total") * train_percent / 100)
    last = [
        F.max(F.when(inside & (F.col(LABEL) == value), F.col("spot"))).alias(f"label{value}")
        for value in LABEL_VALUES
    ]
    edges = ranked.agg(F.struct(*last)).scalar()
    edge = F.coalesce(
        *[F.when(F.col(LABEL) == value, F.col(f"__edges.label{value}")) for value in LABEL_VALUES]
    )
    marked = training.withColumn("__edges", edges)
    return marked.withColumn("is_train", F.coalesce(spot <= edge, F.lit(False))).drop("__edges")


def term_contributions(features: DataFrame) -> DataFrame:
    """Mean absolute contribution of each term of the logit, measured from its mean."""
    terms = latent_terms()
    scored = standard_scores(features).select(
        *[value.alias(name) for name, value in terms.items()]
    )
    means = scored.agg(F.struct(*[F.avg(name).alias(name) for name in terms])).scalar()
    centred = scored.withColumn("__means", means)
    return centred.agg(
        *[F.avg(F.abs(F.col(name) - F.col(f"__means.{name}"))).alias(name) for name in terms]
    ).unpivot([], list(terms), "feature", "mean_abs_contribution")
