"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Sources, in code point order with null last, weigh 1, 2, 3 and again; by these weights
they share the words of all documents. No target exceeds three times its source's words;
what is cut off is shared anew by weight among the others.

A source's target holds so many complete epochs, in which every document is taken whole,
and a rest. For the rest each document gets the key -ln(u) / quality with u drawn from a
hash of its id. Documents are sorted by key within their source and taken while the sum
of their words fits. What then is still open is filled the same way by documents not yet
taken that fit into it, until none fits: a source misses its target by less than the
smallest document it has left. Each round passes on only what still fits, and each takes
at least one document of every source it passes on. Documents are taken whole or not at all.

Size is the number of words; null texts have none and are never taken. Ties of keys go by
doc_id, size and a hash of the row; rows alike in all are equal, and it doesn't matter
which is taken. A source without words has target 0. Documents stay in place: only id,
source, size and key are shuffled. Extra columns are not read; an empty table gives no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, row_struct
from tidemark.session import write_and_read

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = "mix-1"
#: Sampling weight of a document by its quality label, and without one.
GOOD, POOR, UNKNOWN = 2.0, 0.5, 1.0
#: Key ranges for prefix sums; a range of a source is sorted in one task.
_RANGES = 1024


def draw(doc_id: Column, content: Column) -> Column:
    """A number in (0, 1) that depends on the id alone; for a null id, on the row."""
    name = F.coalesce(doc_id.cast("string"), content.cast("string"))
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), name))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, quality: the sampling weight of labelled documents (the best label counts)."""
    return (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("label"))
        .select(F.col("doc_id").cast("long").alias("doc_id"),
                F.when(F.col("label") > 0, GOOD).otherwise(POOR).alias("quality"))
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size): source_no, target, epochs and open words of the rest.

    One row for each source; the windows over all sources sort only these.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("source_no", F.row_number().over(ordered)).withColumn(
        "weight", F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") - 1) % len(WEIGHTS))
    )
    most = F.col("source_size") * MOST_EPOCHS
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    everyone = Window.partitionBy()
    # In this order sources reach their limit one after the other as the level rises.
    levels = (
        weighted.withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("full_before", F.coalesce(
            F.sum(most).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_from", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_from"))
        .withColumn("holds", F.col("level") * F.col("weight") <= most)
        .withColumn("common", F.max(F.when(F.col("holds"), F.col("level"))).over(everyone))
    )
    target = F.least(
        most.cast("double"), F.coalesce(F.col("common") * F.col("weight"), most.cast("double"))
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        levels.withColumn("target", target)
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("open", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        .select("source", "source_no", "source_size", "target", "epochs", "open")
    )


_ROW = ["doc_id", "content", "source_no", "size", "key", "range", "extra"]


def _fill(offered: DataFrame) -> DataFrame:
    """``offered`` with extra = 1 for those taken, in key order, while they fit into ``open``."""
    until = F.sum("held").over(Window.partitionBy("source_no").orderBy("range"))
    ranges = (
        offered.groupBy("source_no", "range", "open")
        .agg(F.sum("size").alias("held"))
        .withColumn("until", until)
        .withColumn("before", F.col("until") - F.col("held"))
        .filter(F.col("before") < F.col("open"))
        .select("source_no", "range", "before", (F.col("until") > F.col("open")).alias("cut"))
    )
    reached = offered.join(ranges, ["source_no", "range"], "left")
    in_order = Window.partitionBy("source_no", "range").orderBy("key", "doc_id", "size", "content")
    summed = F.col("before") + F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    cut = reached.filter("cut").withColumn("extra", (summed <= F.col("open")).cast("int"))
    others = reached.filter("cut IS NULL OR NOT cut").withColumn("extra", F.col("cut").isNotNull().cast("int"))
    return others.select(*_ROW).unionByName(cut.select(*_ROW))


def _offered(rows: DataFrame, budget: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows not taken: those that fit into what is open of their source, and the others."""
    budgeted = rows.join(budget, "source_no")
    fits = (F.col("extra") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("open"))
    return budgeted.filter(fits), budgeted.filter(~fits).select(*_ROW)


def mix(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Every row's doc_id, content (hash of the row), size, source_size, target, copies.

    ``weights`` (doc_id, quality) are positive sampling weights; other documents have 1.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key(docs).alias("content"),
        F.col("source").cast("string").alias("source"),
        words.alias("size"),
    )
    if weights is None:
        base = base.withColumn("quality", F.lit(UNKNOWN))
    else:
        base = base.join(weights, "doc_id", "left").withColumn(
            "quality", F.coalesce("quality", F.lit(UNKNOWN))
        )
    key = -F.log(draw(F.col("doc_id"), F.col("content"))) / F.col("quality")
    place = F.floor((1 - F.exp(-F.col("key"))) * _RANGES)
    base = write_and_read(
        base.withColumn("key", key)
        .withColumn("range", F.least(place, F.lit(_RANGES - 1)).cast("int"))
        .drop("quality"),
        "mix-keys",
    )
    sources = write_and_read(
        source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-sources"
    )
    rows = write_and_read(
        base.alias("b")
        .join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
        .select("b.doc_id", "b.content", "s.source_no", "b.size", "b.key", "b.range")
        .withColumn("extra", F.lit(0)),
        "mix-rows",
    )
    budget = sources.select("source_no", "open")
    used, settled = [], []
    while True:
        offered, others = _offered(rows, budget)
        offered = write_and_read(offered, "mix-offered")
        settled.append(others)
        if offered.isEmpty():
            break
        rows = write_and_read(_fill(offered), "mix-rows")
        used.append(rows.filter("extra = 1").groupBy("source_no").agg(F.sum("size").alias("used")))
        taken = reduce(DataFrame.unionByName, used).groupBy("source_no").agg(F.sum("used").alias("used"))
        budget = write_and_read(
            sources.join(taken, "source_no", "left").select(
                "source_no", (F.col("open") - F.coalesce("used", F.lit(0))).alias("open")
            ),
            "mix-open",
        )
    rows = reduce(DataFrame.unionByName, settled)
    return rows.join(sources.drop("open", "source"), "source_no").select(
        "doc_id", "content", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.col("epochs") + F.col("extra")).otherwise(0).alias("copies"),
    )


def mixed(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row."""
    return mix(docs, weights).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def apply_mix(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The documents as often as the mix takes them, with their columns as they are."""
    copies = (
        mix(docs, weights).groupBy("doc_id", "content").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    )
    rows = docs.select(
        row_struct(docs).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key(docs).alias("content"),
    ).dropDuplicates(["doc_id", "content"])  # equal rows: their copies are added up above
    return (
        rows.alias("d")
        .join(
            copies.alias("c"),
            F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.content") == F.col("c.content")),
        )
        .select("d.row", F.explode(F.sequence(F.lit(1), F.col("c.copies").cast("int"))).alias("copy"))
        .select("row.*")
    )
