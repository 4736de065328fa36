"""Boosted-tree propensity model: fit, batch scoring, evaluation, drivers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.boosting import Ensemble, Settings
from tidemark.operators.boosting import fit as fit_trees
from tidemark.operators.curve import ranking_report
from tidemark.plans.propensity import KEY, LABEL, model_features, numeric_features, score_table
from tidemark.session import write_and_read

# The model's settings.
SETTINGS = Settings(
    trees=400, learning_rate=0.05, depth=6, leaves=31, row_share=0.8, column_share=0.8, seed=42
)


def _names(rows: DataFrame) -> list[str]:
    return [name for name in model_features(rows) if name != "is_train"]


def _inputs(rows: DataFrame) -> DataFrame:
    """Model features as DOUBLE; what is no number counts as missing."""
    numbers = numeric_features(rows)
    return numbers.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in _names(rows)})


def fit(training: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """The ensemble as a table of nodes, from all rows of ``training``."""
    return fit_trees(_inputs(training), _names(training), LABEL, KEY, settings)


def predict(model: Ensemble, rows: DataFrame) -> DataFrame:
    """Key and ``prediction_score``, the probability of conversion; the label too, if there is one."""
    inputs = _inputs(rows)
    kept = [LABEL] if LABEL in rows.columns else []
    keyed = inputs.withColumn("__row", F.struct(KEY, *kept))
    scored = model.scored(keyed, "__row", _names(rows))
    return scored.select("__row.*", F.col("score").alias("prediction_score"))


def score_all(model: Ensemble, rows: DataFrame) -> DataFrame:
    """Score table of every customer, training rows included."""
    return score_table(predict(model, rows), "prediction_score")


def evaluate(model: Ensemble, held_out: DataFrame) -> DataFrame:
    """Ranking metrics of the held-out rows; their predictions are made once and kept."""
    kept = write_and_read(predict(model, held_out), "predictions")
    return ranking_report(kept, LABEL, "prediction_score", KEY)


def contributions(model: Ensemble, rows: DataFrame) -> DataFrame:
    """Key, base and what each feature adds to the log odds of every row."""
    return model.contributions(_inputs(rows), KEY, _names(rows))


def drivers(model: Ensemble, held_out: DataFrame) -> DataFrame:
    """feature, rows and mean_abs_contribution: the mean size of what a feature adds."""
    names = _names(held_out)
    credits = contributions(model, held_out)
    means = credits.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(F.abs(n)).alias(n) for n in names])
    return means.unpivot(["rows"], names, "feature", "mean_abs_contribution").select(
        "feature", "rows", "mean_abs_contribution"
    )
