"""The tables in order of derivation, each written once and then read by later jobs."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.boosting import Ensemble
from tidemark.plans import features, kpis, lookup, model, propensity, search
from tidemark.session import run_dir
from tidemark.sources import retail
from tidemark.sources.tables import TableStore


class Lakehouse:
    """Derived tables of one source folder.

    Projections of source tables stay lazy. Tables that many jobs read (joined items,
    features, training set, scores) are written to the shared folder at first use, as a
    replace-table statement would, so no job repeats the joins and aggregations behind
    them. Tables with one row per customer are bucketed by customer.

    With a ``root`` of its own the lakehouse outlives the application: tables that are
    complete there are opened, not derived again. ``scorer`` names where scores come
    from: ``latent`` is the known propensity, ``model`` the predictions of the stored
    model.
    """

    def __init__(
        self, spark: SparkSession, folder: str, root: str | None = None, scorer: str = "latent"
    ):
        if scorer not in ("latent", "model"):
            raise ValueError(f"unknown scorer: {scorer}")
        self.spark = spark
        self.folder = folder
        self.scorer = scorer
        self.store = TableStore(spark, root or run_dir(spark, "tables"))
        self._written: dict[str, DataFrame] = {}
        self._model: Ensemble | None = None
        self._lock = threading.RLock()

    def _table(self, name: str, build, key: str | None = None) -> DataFrame:
        with self._lock:
            if name not in self._written:
                if self.store.has(name):
                    opened = self.store.read_bucketed(name, key) if key else self.store.read(name)
                    self._written[name] = opened
                elif key:
                    self._written[name] = self.store.replace_bucketed(name, build(), key)
                else:
                    self._written[name] = self.store.replace(name, build())
            return self._written[name]

    def users(self) -> DataFrame:
        return retail.users(self.spark, self.folder)

    def orders(self) -> DataFrame:
        return retail.orders(self.spark, self.folder)

    def orders_raw(self) -> DataFrame:
        return retail.orders_raw(self.spark, self.folder)

    def carts(self) -> DataFrame:
        return retail.carts(self.spark, self.folder)

    def wishlists(self) -> DataFrame:
        return retail.wishlists(self.spark, self.folder)

    def products(self) -> DataFrame:
        return retail.products(self.spark, self.folder)

    def items(self) -> DataFrame:
        """Order items, stored by date: each file holds its own range of days.

        Questions about a period therefore open few files. The customer spreads the rows
        of a busy day over several files.
        """
        by = ["order_date", "user_id"]

        def build() -> DataFrame:
            items = retail.order_items(self.spark, self.folder)
            return items.repartitionByRange(*by).sortWithinPartitions(*by)

        return self._table("fact_order_items", build)

    def _joined_items(self) -> DataFrame:
        """Order items as stored, or as joined while no job has asked for the stored ones.

        An aggregation needs few of their columns and no order of days.
        """
        with self._lock:
            stored = "fact_order_items" in self._written or self.store.has("fact_order_items")
            return self.items() if stored else retail.order_items(self.spark, self.folder)

    def build_features(self) -> DataFrame:
        return features.customer_features(
            self.orders(), self._joined_items(), self.users(), self.carts(), self.wishlists()
        )

    def features(self) -> DataFrame:
        return self._table("customer_features", self.build_features, key="user_id")

    def training(self) -> DataFrame:
        """Training set with the portable label draw."""
        return self._table(
            "training_dataset",
            lambda: propensity.training_dataset(self.features(), portable=True),
            key="user_id",
        )

    def split(self) -> DataFrame:
        """Training set with ``is_train``, by the portable hash."""
        return self._table(
            "split", lambda: propensity.stratified_split(self.training(), portable=True)
        )

    def held_out(self) -> DataFrame:
        return self.split().where(~F.col("is_train")).drop("is_train")

    def model_trees(self) -> DataFrame:
        """The nodes of the propensity model: fitted once on the training rows, then stored."""
        return self._table(
            "model_trees", lambda: model.fit(self.split().where("is_train").drop("is_train"))
        )

    def model(self) -> Ensemble:
        """The stored propensity model, ready to score."""
        with self._lock:
            if self._model is None:
                self._model = Ensemble(self.model_trees())
            return self._model

    def drivers(self) -> DataFrame:
        """Global drivers of the model, from all held-out rows."""
        return self._table("model_drivers", lambda: model.drivers(self.model(), self.held_out()))

    def scores(self) -> DataFrame:
        """Score table: key, score, decile, segment and the time of scoring."""

        def build() -> DataFrame:
            if self.scorer == "model":
                table = model.score_all(self.model(), self.training())
            else:
                table = propensity.score_table(self.training(), propensity.TRUE_PROPENSITY)
            return table.withColumn("scored_at", F.current_timestamp())

        return self._table(f"customer_nbo_scores_{self.scorer}", build, key="user_id")

    def search_index(self) -> search.SearchIndex:
        """The trigram index of the products, its postings stored by trigram."""

        def postings() -> DataFrame:
            found = search.build_index(self.products()).postings
            return found.repartitionByRange("gram", "product_id").sortWithinPartitions("gram", "product_id")

        stored = self._table("search_postings", postings)
        grams = self._table("search_grams", lambda: stored.groupBy("gram").agg(F.count(F.lit(1)).alias("products")))
        return search.SearchIndex(stored, grams)

    def c360(self) -> DataFrame:
        return lookup.customer_360(self.features(), self.scores())

    def category_kpis(self) -> DataFrame:
        return kpis.category_performance_kpi(self.items())


_OPEN: dict[tuple, Lakehouse] = {}


def open_lakehouse(
    spark: SparkSession, folder: str, root: str | None = None, scorer: str = "latent"
) -> Lakehouse:
    """The lakehouse of this application and source folder, or the one stored at ``root``."""
    key = (spark.sparkContext.applicationId, folder, root, scorer)
    if key not in _OPEN:
        _OPEN[key] = Lakehouse(spark, folder, root, scorer)
    return _OPEN[key]
