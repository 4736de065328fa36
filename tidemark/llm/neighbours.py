"""Approximate nearest neighbours with a hash-prefix forest.

Every tree has random hyperplanes; a vector's hash string has one bit for the side of
each. Sorted by hash, vectors with a long common prefix lie side by side, and the index
of a tree is this sorted array, dealt out in blocks of ``BLOCK`` rows.

A search goes in two steps. It descends: in every tree it finds its own place in the
array and looks at the ``NEAR`` rows on either side, those with the longest common
prefixes, of whatever length. From the cosine of the fifth best of these it follows how
long a prefix a vector at least that near shares with chance ``RECALL`` in one of the
trees. Then it ascends in all trees together to that depth and looks at every row below
it. The nearer the neighbours, the deeper the search stays; where vectors lie at random,
it rises almost to the root.

The index holds the vectors' own components, as wide as the table has them. Of the rows
found in a block, those whose cosine by matrix product is within its rounding error of the
last place wanted are scored by the formula of the answer, and the best by that and by id
are kept, however many are alike.

Equal vectors are indexed once, with their six smallest ids; that loses nothing, for five
are asked for and one may be the query itself. Vectors that are null, zero, of another
dimension than most, or hold null or non-finite components take no part, nor do rows
without an id. Repeated rows count once. Rows of one id with different vectors are rows of
their own: each is a query if the id is one, and a neighbour of the other. Ties go to the
smaller id. Components of any size count: vectors are scaled by powers of two before they
are squared. Extra columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import prepare
from tidemark.operators.ordered import global_rank
from tidemark.session import write_and_read

TREES = 24
BITS = 64
BLOCK = 16384
NEAR = 32
RECALL = 0.95
NEIGHBOURS = 5
SEED = 5
#: The block table goes to every task, so it has about this many rows at most; beyond it
#: the blocks grow.
_MOST_BLOCKS = 1 << 20
#: Searches that share one copy of a block.
_SEARCHES = 20_000


def _planes(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, TREES * BITS))


def hashes(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash string of each vector in each tree; as signed numbers they sort like the strings."""
    bits = np.packbits(vectors @ planes > 0, axis=1)
    strings = bits.reshape(len(vectors), TREES, BITS // 8).copy().view(">u8")[..., 0]
    return (strings.astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _rows(codes: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(codes), kind).reshape(len(codes), -1).astype(float)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1.

    It changes no cosine, but keeps squares of very large or small components in range.
    """
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(1))


def classes(embeddings: DataFrame) -> DataFrame:
    """Distinct usable vectors: cid (number by smallest id), members (six smallest ids), vector, asked."""
    usable = (
        embeddings.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("embedding").cast("array<double>").alias("vector"),
        )
        .filter("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
        .filter(
            F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("vector", lambda x: x != 0)
        )
        .withColumn("vector", F.transform("vector", lambda x: x + 0.0))  # -0.0 becomes 0.0
        .dropDuplicates(["vec_id", "vector"])
    )
    usable = write_and_read(usable, "vectors")
    sizes = usable.groupBy(F.size("vector").alias("size")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("size")).select("size").first()
    usable = usable.filter(F.size("vector") == (common.size if common else 0))
    asked = usable.groupBy("vector").agg(F.max(F.col("vec_id") % 50 == 0).alias("asked"))
    # The limit on the row number is applied in each task before rows meet.
    smallest = (
        usable.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id")))
        .filter(F.col("n") <= NEIGHBOURS + 1)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    )
    joined = smallest.join(asked, "vector").withColumn("least", F.element_at("members", 1))
    # Numbers in the order of the smallest id; one id may stand on several vectors.
    ranked = global_rank(joined, [F.col("least"), F.xxhash64("vector")], "cid", "classes")
    return ranked.select(F.col("cid").cast("long").alias("cid"), "members", "vector", "asked")


def _forest(found: DataFrame, size: int, rows: int, kind: str) -> DataFrame:
    """Sorted arrays of all trees: block, tree, hash, cid, asked, code."""
    planes = _planes(size)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.array(batch.column("vector").to_pylist(), float)
            strings, codes = hashes(_scaled(vectors), planes), vectors.astype(kind)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            for tree in range(TREES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(vectors), tree, np.int32)), pa.array(strings[:, tree].copy()),
                     batch.column("cid"), batch.column("asked"), packed],
                    ["tree", "hash", "cid", "asked", "code"],
                )

    block = max(BLOCK, -(-rows * TREES // _MOST_BLOCKS))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            blocks = (part << 32) + (seen + np.arange(batch.num_rows)) // block
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks), *batch.columns], ["block", *batch.schema.names]
            )

    planted = write_and_read(
        found.select("cid", "asked", "vector").mapInArrow(
            plant, "tree int, hash long, cid long, asked boolean, code binary"
        ),
        "forest-unsorted",
    )
    sorted_ = (
        planted.repartitionByRange("tree", "hash", "cid")
        .sortWithinPartitions("tree", "hash", "cid")
        .mapInArrow(number, "block long, tree int, hash long, cid long, asked boolean, code binary")
    )
    return write_and_read(sorted_, "forest")


def _best(sims: np.ndarray, count: int) -> np.ndarray:
    if len(sims) <= count:
        return np.arange(len(sims))
    return np.argpartition(-sims, count - 1)[:count]


def _descend(part: pd.DataFrame, kind: str) -> pd.DataFrame:
    """The nearest of the rows beside each search in each tree of a block."""
    part = part.sort_values(["tree", "hash", "cid"])
    unit, cids, trees = _unit(_rows(list(part["code"]), kind)), part["cid"].to_numpy(), part["tree"].to_numpy()
    asks, found, sims = [], [], []
    for place in np.flatnonzero(part["asked"].to_numpy()):
        low = max(place - NEAR, np.searchsorted(trees, trees[place]))
        high = min(place + NEAR + 1, np.searchsorted(trees, trees[place], "right"))
        near = np.delete(np.arange(low, high), place - low)
        sim = unit[near] @ unit[place]
        best = _best(sim, NEIGHBOURS)
        asks += [cids[place]] * len(best)
        found += cids[near[best]].tolist()
        sims += sim[best].tolist()
    return pd.DataFrame({"ask": asks, "cid": found, "sim": sims})


def depth(cosine: float | None) -> int:
    """Prefix length that a vector this near shares with chance RECALL in one of the trees."""
    if cosine is None:
        return 0
    same_bit = 1 - math.acos(min(max(cosine, -1.0), 1.0)) / math.pi
    needed = 1 - (1 - RECALL) ** (1 / TREES)
    if same_bit >= needed ** (1 / BITS):
        return BITS
    return max(0, math.floor(math.log(needed) / math.log(same_bit))) if same_bit > 0 else 0


def _searches(asked: DataFrame, bounds: pd.DataFrame, size: int, kind: str) -> DataFrame:
    """Which blocks each search looks through, and the range of hashes it may take there."""
    planes = _planes(size)
    blocks, trees = bounds["block"].to_numpy(), bounds["tree"].to_numpy()
    lows, highs = bounds["low"].to_numpy(), bounds["high"].to_numpy()
    begins = np.searchsorted(trees, np.arange(TREES + 1))

    def ascend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.array(batch.column("vector").to_pylist(), float)
            strings, codes = hashes(_scaled(vectors), planes).view(np.uint64) ^ np.uint64(1 << 63), vectors.astype(kind)
            out: list[tuple] = []
            for i, (cid, fifth) in enumerate(
                zip(batch.column("cid").to_pylist(), batch.column("fifth").to_pylist())
            ):
                free = np.uint64((1 << (BITS - depth(fifth))) - 1)
                first = ((strings[i] & ~free) ^ np.uint64(1 << 63)).view(np.int64)
                last = ((strings[i] | free) ^ np.uint64(1 << 63)).view(np.int64)
                for tree in range(TREES):
                    a, b = begins[tree], begins[tree + 1]
                    low = a + np.searchsorted(highs[a:b], first[tree])
                    high = a + np.searchsorted(lows[a:b], last[tree], "right")
                    out += [(int(blocks[k]), cid, tree, int(first[tree]), int(last[tree]), codes[i].tobytes())
                            for k in range(low, high)]
                if len(out) > 20_000 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(
                            zip(*out),
                            (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()),
                        )],
                        ["block", "ask", "tree", "first", "last", "ask_code"],
                    ) if out else pa.RecordBatch.from_pylist([], schema=_VISITS)
                    out = []

    return asked.mapInArrow(
        ascend, "block long, ask long, tree int, first long, last long, ask_code binary"
    )


_VISITS = pa.schema(
    [("block", pa.int64()), ("ask", pa.int64()), ("tree", pa.int32()), ("first", pa.int64()),
     ("last", pa.int64()), ("ask_code", pa.binary())]
)


def _look(rows: pd.DataFrame, visits: pd.DataFrame, kind: str) -> pd.DataFrame:
    """Best rows of one block for the searches that reach it."""
    asks, found, sims = [], [], []
    if len(rows) and len(visits):
        rows = rows.sort_values(["tree", "hash", "cid"])
        vectors, cids, strings = _scaled(_rows(list(rows["code"]), kind)), rows["cid"].to_numpy(), rows["hash"].to_numpy()
        unit, lengths, trees = _unit(vectors), _lengths(vectors), rows["tree"].to_numpy()
        # Twice the rounding error of a cosine by matrix product, and by the formula.
        slack = 8 * (vectors.shape[1] + 8) * np.finfo(float).eps
        # Searches of one range share a matrix product.
        for (tree, first, last), part in visits.groupby(["tree", "first", "last"], sort=False):
            a, b = np.searchsorted(trees, tree), np.searchsorted(trees, tree, "right")
            low, high = a + np.searchsorted(strings[a:b], first), a + np.searchsorted(strings[a:b], last, "right")
            if low == high:
                continue
            asking = part["ask"].to_numpy()
            for k in range(0, len(part), 256):
                asked = _scaled(_rows(list(part["ask_code"].iloc[k : k + 256]), kind))
                sim = _unit(asked) @ unit[low:high].T
                for ask, vector, length, row in zip(asking[k : k + 256], asked, _lengths(asked), sim):
                    # One more than wanted, for the search may be among them.
                    least = row[_best(row, NEIGHBOURS + 1)].min()
                    near = low + np.flatnonzero(row >= least - slack)
                    score = (vector * vectors[near]).sum(1) / (length * lengths[near])
                    best = np.lexsort((cids[near], -score))[: NEIGHBOURS + 1]
                    asks.append(np.full(len(best), ask))
                    found.append(cids[near[best]])
                    sims.append(score[best])
    if not asks:
        return pd.DataFrame({"ask": [], "cid": [], "sim": []}).astype({"ask": "int64", "cid": "int64"})
    found_ = pd.DataFrame({"ask": np.concatenate(asks), "cid": np.concatenate(found), "sim": np.concatenate(sims)})
    # A block may hold rows of two trees, and so one vector twice.
    found_ = found_[found_["ask"] != found_["cid"]].drop_duplicates(["ask", "cid"])
    return found_.sort_values(["ask", "sim", "cid"], ascending=[True, False, True]).groupby("ask").head(NEIGHBOURS)


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a = _scaled(np.array(batch.column("ask_vector").to_pylist(), float))
            b = _scaled(np.array(batch.column("vector").to_pylist(), float))
            cosine = (a * b).sum(1) / (_lengths(a) * _lengths(b))
            yield pa.RecordBatch.from_arrays(
                [batch.column("ask"), batch.column("cid"), batch.column("members"), pa.array(cosine)],
                ["ask", "cid", "members", "score"],
            )


def nearest(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the five nearest of every row with an id divisible by 50."""
    spark = prepare(embeddings.sparkSession)
    shape = "query_id long, rank int, vec_id long, score double"
    found = write_and_read(classes(embeddings), "vector-classes")
    first = found.select(F.size("vector").alias("size")).first()
    if first is None:
        return spark.createDataFrame([], shape)
    kind = "<f4" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "<f8"
    forest = _forest(found, first.size, found.count(), kind)
    near = forest.groupBy("block").applyInPandas(
        lambda part: _descend(part, kind), "ask long, cid long, sim double"
    )
    by_nearness = Window.partitionBy("ask").orderBy(F.desc("sim"))
    fifths = (
        near.groupBy("ask", "cid")
        .agg(F.max("sim").alias("sim"))
        .withColumn("n", F.row_number().over(by_nearness))
        .filter(F.col("n") == NEIGHBOURS)
        .select(F.col("ask").alias("cid"), F.col("sim").alias("fifth"))
    )
    asked = found.filter("asked").select("cid", "vector").join(fifths, "cid", "left")
    bounds = (
        forest.groupBy("tree", "block")
        .agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
        .toPandas()
        .sort_values(["tree", "low", "block"])
    )
    visits = write_and_read(_searches(asked, bounds, first.size, kind), "visits")
    # A block that many searches reach is copied, and each copy serves some of them.
    copies = visits.groupBy("block").agg(F.ceil(F.count("*") / _SEARCHES).cast("int").alias("copies"))
    dealt = visits.join(copies, "block").withColumn(
        "copy", F.pmod(F.xxhash64("ask"), F.col("copies")).cast("int")
    )
    rows = forest.join(copies, "block").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    )
    seen = (
        rows.select("block", "copy", "tree", "hash", "cid", "code")
        .groupBy("block", "copy")
        .cogroup(
            dealt.select("block", "copy", "ask", "tree", "first", "last", "ask_code").groupBy("block", "copy")
        )
        .applyInPandas(lambda rows, visits: _look(rows, visits, kind), "ask long, cid long, sim double")
    )
    kept = (
        write_and_read(seen, "candidates")
        .groupBy("ask", "cid")
        .agg(F.max("sim").alias("sim"))
        .withColumn("n", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("sim"), "cid")))
        .filter(F.col("n") <= NEIGHBOURS)
        .select("ask", "cid")
    )
    # A search's own class is among its candidates: equal vectors are its nearest.
    own = found.filter("asked").select(F.col("cid").alias("ask"), "cid")
    asking = found.filter("asked").select(F.col("cid").alias("ask"), F.col("vector").alias("ask_vector"))
    scored = (
        kept.unionByName(own)
        .join(found.select("cid", "members", "vector"), "cid")
        .join(asking, "ask")
        .select("ask", "cid", "members", "ask_vector", "vector")
        .mapInArrow(_cosines, "ask long, cid long, members array<long>, score double")
        .select("ask", "cid", F.explode("members").alias("vec_id"), "score")
    )
    order = [F.desc("score"), F.col("vec_id")]
    best = write_and_read(
        scored.withColumn("n", F.row_number().over(Window.partitionBy("ask").orderBy(*order)))
        .filter(F.col("n") <= NEIGHBOURS + 1)
        .select("ask", "cid", "vec_id", "score"),
        "best",
    )
    queries = (
        embeddings.select(
            F.col("vec_id").cast("long").alias("query_id"),
            F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0).alias("ask_vector"),
        )
        .filter("query_id % 50 = 0")
        .distinct()
        .join(asking, "ask_vector")
        .select("query_id", "ask")
    )
    return (
        queries.join(best, "ask")
        .filter("query_id <> vec_id OR ask <> cid")
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "ask").orderBy(*order)))
        .filter(F.col("rank") <= NEIGHBOURS)
        .select("query_id", "rank", "vec_id", "score")
    )
