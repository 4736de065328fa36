import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import murmur_abs_bucket, portable_hash
from tidemark.operators.measures import MetricView
from tidemark.plans import propensity


def test_known_hashes(spark):
    row = spark.range(1).select(
        F.hash(F.lit(350)).alias("int"),
        F.hash(F.lit(350).cast("bigint")).alias("long"),
        portable_hash(F.lit(350)).alias("portable"),
        murmur_abs_bucket(4, F.lit(350)).alias("bucket"),
    ).first()
    assert (row["int"], row["long"]) == (1826056424, -1867957834)
    assert row["portable"] == int(hashlib.md5(b"350").hexdigest()[:8], 16)
    assert row["bucket"] == 1826056424 % 4


def constant(features):
    return features.withColumn("wishlist_count", F.lit(3).cast("bigint"))


def test_constant_feature_gives_no_propensity_and_label_0(lake):
    training = propensity.training_dataset(constant(lake.features()))
    assert training.where("propensity_true IS NOT NULL OR label_conversion <> 0").count() == 0
    filled = propensity.training_dataset(constant(lake.features()), null_as_zero=True)
    assert filled.where("propensity_true IS NULL").count() == 0


def test_labels_follow_the_propensity(lake):
    for portable in (True, False):
        training = propensity.training_dataset(lake.features(), portable=portable)
        row = training.agg(F.avg("label_conversion").alias("rate"), F.avg("propensity_true").alias("p")).first()
        assert abs(row.rate - row.p) < 0.15
        again = propensity.training_dataset(lake.features(), portable=portable)
        assert training.exceptAll(again).count() == 0


def test_no_leakage(lake):
    training = lake.training()
    assert propensity.model_features(training) == propensity.FEATURES
    assert propensity.leakage_safe(training).columns == propensity.FEATURES


def test_numeric_features_turn_bad_text_into_null(lake):
    text = lake.training().withColumn("aov", F.when(F.col("user_id") == 1, "n/a").otherwise("3.5"))
    df = propensity.numeric_features(text)
    assert dict(df.dtypes)["aov"] == "double"
    assert df.where("aov IS NULL").count() == 1


def test_split_keeps_each_labels_share(lake):
    split = propensity.stratified_split(lake.training())
    rows = split.groupBy("label_conversion").agg(
        F.count("*").alias("n"), F.count_if("is_train").alias("train")
    ).collect()
    assert all(r.train == r.n * 75 // 100 for r in rows)
    assert split.count() == lake.training().count()


def test_scores_cover_every_customer(lake):
    scores = lake.scores()
    assert scores.count() == lake.features().count() == scores.select("user_id").distinct().count()
    worst = scores.groupBy("decile").agg(F.min("propensity_score").alias("lo"), F.max("propensity_score").alias("hi"))
    rows = worst.orderBy("decile").collect()
    assert all(a.hi <= b.lo for a, b in zip(rows, rows[1:]))


def test_undefined_measure_is_an_error(lake):
    view = MetricView(lake.features(), {}, {})
    with pytest.raises(KeyError):
        view.query(["revenue"])
