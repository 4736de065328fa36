"""Quality of a ranking score against a binary label.

Rows are first counted per distinct score, so equal scores are grouped and a frequent
score is combined before the shuffle; prefix sums then run over distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import global_rank, running_totals


def score_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score, descending: positives, negatives and their running totals."""
    per_score = df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum(1 - F.col(label).cast("bigint")).alias("neg"),
    )
    return running_totals(per_score, [F.col("score").desc()], ["pos", "neg"])


def _average_precision() -> Column:
    """Step-wise area: precision at each distinct score, weighted by its share of positives."""
    precision = F.col("run_pos") / (F.col("run_pos") + F.col("run_neg"))
    weight = F.col("pos") / F.nullif(F.col("all_pos"), F.lit(0))
    return F.sum(weight * precision)


def _roc_auc() -> Column:
    """Share of (positive, negative) pairs in the right order; ties count one half."""
    below = F.col("all_neg") - F.col("run_neg")
    half_wins = (2 * below + F.col("neg")).cast("decimal(19,0)")
    wins = F.sum(F.col("pos").cast("decimal(19,0)") * half_wins)
    pairs = F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
    return wins.cast("double") / 2 / F.nullif(pairs, F.lit(0.0))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    return score_curve(df, label, score).agg(_average_precision().alias("average_precision"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    return score_curve(df, label, score).agg(_roc_auc().alias("roc_auc"))


def brier(label: Column, score: Column) -> Column:
    return F.avg((score - label) * (score - label))


def precision_at_fraction(
    df: DataFrame, label: str, score: str, key: str, fraction_percent: int = 10
) -> DataFrame:
    """Precision and lift among the best-scored share of rows, at least one row."""
    ranked = global_rank(df.select(key, label, score), [F.col(score).desc(), F.col(key)])
    size = F.greatest(F.lit(1), F.floor(F.col("total") * fraction_percent / 100))
    chosen = F.col("rank") <= size
    base = F.avg(F.col(label).cast("double"))
    precision = F.avg(F.when(chosen, F.col(label).cast("double")))
    return ranked.agg(
        F.count_if(chosen).alias("k"),
        base.alias("base_rate"),
        precision.alias("precision_at_k"),
        (precision / F.nullif(base, F.lit(0.0))).alias("lift_at_k"),
    )


def ranking_report(df: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """All ranking metrics in one row, from one pass over the curve and one rank."""
    areas = F.struct(_average_precision().alias("pr_auc"), _roc_auc().alias("roc_auc"))
    curve = score_curve(df, label, score).agg(areas).scalar()
    loss = df.agg(brier(F.col(label).cast("double"), F.col(score))).scalar()
    at_k = precision_at_fraction(df, label, score, key).withColumn("__areas", curve)
    return at_k.select("*", "__areas.*", loss.alias("brier")).drop("__areas")
