"""Gradient-boosted trees with a limit on leaves, grown best first over binned features.

Binning. Every value falls into a cell (its sign, exponent and first eight bits of its
fraction), and the cells of a feature are joined into at most ``BINS`` bins of about equal
count. Cells are counted by an aggregation, so the bins depend on the rows alone. A
missing value has a bin of its own, below all others.

Growth. A node's best split depends on its rows only, so the order of growth decides no
split, only which of them are made. One pass over the rows gives, for all open nodes of a
level, the sums of gradients by (node, feature, bin); of two siblings one is summed, the
other is the parent less it. After the last level the splits are made in order of gain
until the tree has its number of leaves, which is best-first growth with as many passes as
levels. Gradients are rounded to whole numbers of 2**-20, so sums do not depend on the
order of additions and the trees can be recomputed exactly.

Passes. Rows lie as blocks of plain arrays (a byte a bin), some 35 bytes a row. A pass adds
up its blocks in each task; partial sums, of a size set by nodes, features and bins alone,
are dealt by node and meet in tasks, which choose the nodes' splits. The driver gets one
split a node, whatever the number of tasks; here every node is summed, since no task holds
its parent's sums. Hundreds of passes of a few milliseconds each are why they are RDD jobs:
planning a query takes longer than such a pass. Where one partition holds all blocks (64 MB
at Spark's setting) there is nothing to meet, and its task grows the trees of a round by the
same code. Every ``ROUND`` trees the scores so far are written with the blocks to the shared
folder; a lost executor costs its blocks of that round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from copy import copy
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship_package, write_and_read

BINS = 64
ROUND = 20
BLOCK_ROWS = 1 << 16
#: Partial sums of so many tasks meet in one.
_FEW = 8
_SCALE = 1 << 20
#: Bits of a double below its cell: 52 of the fraction less eight.
_BELOW = 44
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    trees: int = 400
    learning_rate: float = 0.05
    depth: int = 6
    leaves: int = 31
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 42
    #: Least rows of a leaf.
    least_rows: int = 20


@dataclass(frozen=True)
class Tree:
    """Nodes in heap order: those under ``i`` are 2i+1 (left) and 2i+2. A feature of -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    rows: np.ndarray


def cells_of(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of ``values``, equal for values of one cell."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, -(bits & 0x7FFFFFFFFFFFFFFF) >> _BELOW, bits >> _BELOW)


def first_of(cell: int) -> float:
    """The smallest value of a cell."""
    size = float(np.int64(abs(int(cell)) << _BELOW).view(np.float64))
    return size if cell >= 0 else -size


def bin_ends(cells: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Last cell of every bin but the top one: bins of about equal count, missing values apart."""
    order = np.argsort(cells)
    cells, counts = cells[order], counts[order]
    if not len(cells):
        return np.zeros(0, np.int64)
    share = (np.cumsum(counts) * (bins - 1) - 1) // counts.sum()
    ends = np.flatnonzero(np.diff(share) > 0)
    return cells[ends]


def _cell_counts(table: DataFrame, features: Sequence[str]) -> dict[str, np.ndarray]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, name in enumerate(features):
                values = batch.column(name).to_numpy(zero_copy_only=False)
                cells, counts = np.unique(cells_of(values[~np.isnan(values)]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(cells), pa.int32()), pa.array(cells), pa.array(counts)],
                    ["feature", "cell", "n"],
                )

    counted = table.select(*features).mapInArrow(count, "feature int, cell long, n long")
    rows = counted.groupBy("feature", "cell").agg(F.sum("n").alias("n")).toPandas()
    ends = {}
    for number, name in enumerate(features):
        own = rows[rows["feature"] == number]
        ends[name] = bin_ends(own["cell"].to_numpy(np.int64), own["n"].to_numpy(np.int64))
    return ends


def bins_of(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bin of each value: 0 for a missing one, 1 up to the first end, and so on."""
    missing = np.isnan(values)
    found = np.searchsorted(ends, cells_of(np.where(missing, 0.0, values))) + 1
    return np.where(missing, 0, found).astype(np.uint8)


_BLOCK = "rows int, bins binary, label binary, spot binary, score binary"


def _blocks(table: DataFrame, features: Sequence[str], ends: dict[str, np.ndarray]) -> DataFrame:
    """Rows as blocks: bins by row, label, hash of the key, score so far."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def block() -> pa.RecordBatch:
            bins, label, spot = (np.concatenate(part) for part in zip(*held))
            held.clear()
            parts = [bins, label, spot, np.zeros(len(label))]
            return pa.RecordBatch.from_arrays(
                [pa.array([len(label)], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)],
                ["rows", "bins", "label", "spot", "score"],
            )

        for batch in batches:
            columns = [bins_of(batch.column(n).to_numpy(zero_copy_only=False), ends[n]) for n in features]
            label = batch.column("label").to_numpy().astype(np.uint8)
            held.append((np.stack(columns, axis=1), label, batch.column("spot").to_numpy()))
            if sum(len(h[1]) for h in held) >= BLOCK_ROWS:
                yield block()
        if held:
            yield block()

    return table.mapInArrow(pack, _BLOCK)


class Block:
    """One block's arrays: bins by row, and for the tree at hand the gradients of the rows it draws."""

    def __init__(self, rows: int, bins: bytes, label: bytes, spot: bytes, score: bytes) -> None:
        self.bins = np.frombuffer(bins, np.uint8).reshape(rows, -1)
        self.label = np.frombuffer(label, np.uint8)
        self.spot = np.frombuffer(spot, np.uint64)
        self.score = np.frombuffer(score, np.float64)

    def ready(self, base: float, trees: Sequence[Tree], number: int, settings: Settings) -> Block:
        """The block for tree ``number``, after the values of ``trees`` are added."""
        after = copy(self)
        after.score = add_trees(self.bins, self.score, trees, settings.depth)
        after.rows = np.flatnonzero(drawn(self.spot, number, settings.row_share))
        first, second = gradients(self.label[after.rows], base + after.score[after.rows])
        after.first, after.second = first.astype(np.int32), second.astype(np.int32)
        return after


def leaf_numbers(bins: np.ndarray, tree: Tree, depth: int) -> np.ndarray:
    """Number of the node where each row ends."""
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for _ in range(depth):
        feature = tree.feature[node]
        on = feature >= 0
        right = bins[rows, np.maximum(feature, 0)] > tree.bin[node]
        node = np.where(on, 2 * node + 1 + right, node)
    return node


def add_trees(bins: np.ndarray, score: np.ndarray, trees: Sequence[Tree], depth: int) -> np.ndarray:
    for tree in trees:
        score = score + tree.value[leaf_numbers(bins, tree, depth)]
    return score


def drawn(spot: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Whether a row takes part in a tree, by the hash of its key."""
    mixed = (spot ^ np.uint64(tree + 1)) * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
    return (mixed >> np.uint64(40)).astype(np.float64) < share * (1 << 24)


def gradients(label: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss, as whole numbers of 2**-20."""
    chance = 1.0 / (1.0 + np.exp(-score))
    return np.rint((chance - label) * _SCALE), np.rint(chance * (1.0 - chance) * _SCALE)


def sums_in(block: Block, grown: Tree, slots: np.ndarray, columns: np.ndarray, depth: int) -> np.ndarray:
    """Sums (gradient, curvature, rows) of one block by (slot, column, bin).

    ``slots`` numbers the nodes to be summed; -1 leaves a node out.
    """
    bins, first, second = block.bins[block.rows], block.first, block.second
    slot = slots[leaf_numbers(bins, grown, depth)]
    if slot.min(initial=0) < 0:
        kept = slot >= 0
        slot, bins, first, second = slot[kept], bins[kept], first[kept], second[kept]
    size = (int(slots.max()) + 1) * BINS
    found = np.zeros((3, len(columns), size), np.int64)
    for i, column in enumerate(columns):
        cell = slot * BINS + bins[:, column]
        found[0, i] = np.bincount(cell, first, size)
        found[1, i] = np.bincount(cell, second, size)
        found[2, i] = np.bincount(cell, minlength=size)
    return found.reshape(3, len(columns), -1, BINS).transpose(2, 0, 1, 3)


def best_split(sums: np.ndarray, least_rows: int) -> tuple[float, int, int] | None:
    """(gain, place of the column, last bin on the left) of one node's sums, None if none gains.

    Of equal gains the first column, then the lowest bin.
    """
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    total = sums[:, 0].sum(axis=1)[:, None, None]
    right = total - left
    fits = (left[2] >= least_rows) & (right[2] >= least_rows) & (left[1] > 0) & (right[1] > 0)
    if not fits.any():
        return None

    def strength(part: np.ndarray) -> np.ndarray:
        return part[0].astype(np.float64) ** 2 / np.maximum(part[1], 1)

    gain = np.where(fits, strength(left) + strength(right) - strength(total), -np.inf)
    place = int(gain.argmax())
    if not gain.flat[place] > 0:
        return None
    return float(gain.flat[place]), *divmod(place, gain.shape[1])


def columns_of(features: int, number: int, settings: Settings) -> np.ndarray:
    """The features that a tree may use."""
    count = max(1, int(np.ceil(features * settings.column_share)))
    order = np.random.default_rng([settings.seed, number]).permutation(features)
    return np.sort(order[:count])


def kept_splits(gains: dict[int, float], leaves: int) -> set[int]:
    """Nodes split when growth goes best first and ends at ``leaves`` leaves."""
    queue = [(-gains[0], 0)] if 0 in gains else []
    kept: set[int] = set()
    while queue and len(kept) + 1 < leaves:
        _, node = heapq.heappop(queue)
        kept.add(node)
        for child in (2 * node + 1, 2 * node + 2):
            if child in gains:
                heapq.heappush(queue, (-gains[child], child))
    return kept


class Choice(NamedTuple):
    """A node's sums (gradient, curvature, rows), its best split if one gains, and the sums left of it."""

    whole: np.ndarray
    split: tuple[float, int, int] | None
    left: np.ndarray | None


def choice_of(sums: np.ndarray, least_rows: int) -> Choice:
    """The choice for one node from its sums by (column, bin)."""
    split = best_split(sums, least_rows)
    left = None if split is None else sums[:, split[1], : split[2] + 1].sum(axis=1)
    return Choice(sums[:, 0].sum(axis=1), split, left)


def _slots(nodes: Sequence[int], depth: int) -> np.ndarray:
    slots = np.full(2 ** (depth + 1) - 1, -1)
    slots[list(nodes)] = np.arange(len(nodes))
    return slots


def grow(choose, number: int, features: int, settings: Settings) -> Tree:
    """One tree; ``choose(grown, level, columns)`` gives the choice of each node of a level."""
    nodes = 2 ** (settings.depth + 1) - 1
    feature, bins = np.full(nodes, -1), np.zeros(nodes, np.int64)
    value, rows = np.zeros(nodes), np.zeros(nodes, np.int64)
    columns = columns_of(features, number, settings)
    gains: dict[int, float] = {}
    level = [0]
    for depth in range(settings.depth):
        if not level:
            break
        choices = choose(Tree(feature, bins, value, rows), level, columns)
        if depth == 0:
            value[0], rows[0] = _value(choices[0].whole, settings), choices[0].whole[2]
        following = []
        for node in level:
            whole, split, left = choices[node]
            if split is None:
                continue
            gains[node], column, last = split
            feature[node], bins[node] = columns[column], last
            for child, part in ((2 * node + 1, left), (2 * node + 2, whole - left)):
                value[child], rows[child] = _value(part, settings), part[2]
                following.append(child)
        level = following
    made = kept_splits(gains, settings.leaves)
    feature[[n for n in range(nodes) if n not in made]] = -1
    return Tree(feature, bins, value, rows)


def _value(sums: np.ndarray, settings: Settings) -> float:
    return -settings.learning_rate * float(sums[0]) / float(sums[1]) if sums[1] > 0 else 0.0


def base_score(ones: int, rows: int) -> float:
    """Log odds of the labels' mean, within reason where there is one label only."""
    share = min(max(ones / max(rows, 1), 1e-6), 1 - 1e-6)
    return float(np.log(share / (1 - share)))


NODES = "tree int, node int, feature string, edge double, left int, right int, value double, rows long"


def as_rows(trees: Sequence[Tree], features: Sequence[str], ends: dict[str, np.ndarray], base: float) -> list[tuple]:
    """The ensemble as a table: tree 0 holds the base score, the others their reachable nodes.

    A row goes to ``left`` where the feature is missing or below ``edge``.
    """
    found: list[tuple] = [(0, 0, None, None, None, None, base, None)]
    for number, tree in enumerate(trees, 1):
        todo = [0]
        while todo:
            node = todo.pop()
            value, rows = float(tree.value[node]), int(tree.rows[node])
            if tree.feature[node] < 0:
                found.append((number, node, None, None, None, None, value, rows))
                continue
            name, last = features[tree.feature[node]], int(tree.bin[node])
            # Bin 0 alone on the left: only missing values go there.
            edge = first_of(int(ends[name][last - 1]) + 1) if last else float("-inf")
            found.append((number, node, name, edge, 2 * node + 1, 2 * node + 2, value, rows))
            todo += [2 * node + 2, 2 * node + 1]
    return found


def fit(rows: DataFrame, features: Sequence[str], label: str, key: str, settings: Settings) -> DataFrame:
    """The ensemble of ``rows`` as the table ``NODES``; features are DOUBLE, missing ones null.

    A null label leaves a row out; an empty table gives the base score alone.
    """
    spark = ship_package(rows.sparkSession)
    narrow = rows.filter(F.col(label).isNotNull()).select(
        *features, F.col(label).cast("int").alias("label"), F.xxhash64(key).alias("spot")
    )
    narrow = write_and_read(narrow.hint("rebalance"), "boosting-rows")
    size = narrow.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    ends = _cell_counts(narrow, features)
    base = base_score(size.ones, size.rows)
    state = write_and_read(_blocks(narrow, features, ends), "boosting-blocks")
    trees: list[Tree] = []
    while len(trees) < settings.trees and size.rows:
        made = _round(state, base, range(len(trees), min(len(trees) + ROUND, settings.trees)), len(features), settings)
        trees += made
        if len(trees) < settings.trees:
            state = write_and_read(_scored(state, made, settings.depth), "boosting-blocks")
    table = as_rows(trees, features, ends, base)
    return spark.createDataFrame(table, NODES)


def _sums_of(blocks: Iterable[Block], grown: Tree, slots: np.ndarray, columns: np.ndarray, depth: int):
    total = None
    for block in blocks:
        found = sums_in(block, grown, slots, columns, depth)
        total = found if total is None else total + found
    return total


def _grown_in_task(blocks: list[Block], base: float, numbers: range, features: int, settings: Settings) -> Iterator[Tree]:
    """The trees ``numbers`` where one task holds all blocks, so that no sums have to meet.

    One node of each pair of siblings is summed, the left one; the other is the parent less it.
    """
    newest: list[Tree] = []
    sums: dict[int, np.ndarray] = {}
    for number in numbers:
        blocks = [b.ready(base, newest, number, settings) for b in blocks]

        def choose(grown: Tree, level: list[int], columns: np.ndarray, own=blocks) -> dict[int, Choice]:
            nonlocal sums
            asked = [n for n in level if n == 0 or n % 2 == 1]
            found = _sums_of(own, grown, _slots(asked, settings.depth), columns, settings.depth)
            above, sums = sums, dict(zip(asked, found))
            for node in level:
                if node not in sums:
                    sums[node] = above[(node - 1) // 2] - sums[node - 1]
            return {node: choice_of(sums[node], settings.least_rows) for node in level}

        newest = [grow(choose, number, features, settings)]
        yield newest[0]


def _round(state: DataFrame, base: float, numbers: range, features: int, settings: Settings) -> list[Tree]:
    """The trees ``numbers``, one after the other; each one's blocks are kept until the next one's are."""
    made: list[Tree] = []
    blocks = state.rdd.map(lambda r: Block(*r))
    if blocks.getNumPartitions() == 1:
        return blocks.mapPartitions(lambda own: _grown_in_task(list(own), base, numbers, features, settings)).collect()
    held = []
    for number in numbers:
        newest = made[-1:]
        blocks = blocks.map(lambda b, newest=newest, number=number: b.ready(base, newest, number, settings))
        held.append(blocks.persist(StorageLevel.MEMORY_AND_DISK))

        def choose(grown: Tree, level: list[int], columns: np.ndarray, own=blocks) -> dict[int, Choice]:
            slots = _slots(level, settings.depth)

            def part(block_of: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
                total = _sums_of(block_of, grown, slots, columns, settings.depth)
                if total is not None:
                    yield from zip(level, total)

            tasks = min(len(level), -(-own.getNumPartitions() // _FEW))
            met = own.mapPartitions(part).reduceByKey(np.add, tasks)
            return dict(met.mapValues(lambda sums: choice_of(sums, settings.least_rows)).collect())

        made.append(grow(choose, number, features, settings))
        if len(held) > 1:
            held.pop(0).unpersist()
    held.pop().unpersist()
    return made


def _scored(state: DataFrame, trees: Sequence[Tree], depth: int) -> DataFrame:
    """The blocks with the trees' values added to their scores."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(**row)
                score = add_trees(block.bins, block.score, trees, depth)
                yield pa.RecordBatch.from_pylist([row | {"score": score.tobytes()}], batch.schema)

    return state.mapInArrow(add, _BLOCK)


class Ensemble:
    """A fitted table of nodes, read once (bounded by trees and leaves), walked in arrays.

    As one column expression, 400 trees took 15 seconds for 15,000 rows, most of it code
    generation; walked batch by batch they take under one.
    """

    def __init__(self, table: DataFrame) -> None:
        self.trees: dict[int, dict[int, tuple]] = {}
        self.base = 0.0
        columns = ["tree", "node", "feature", "edge", "left", "right", "value"]
        for tree, node, *rest in table.select(*columns).orderBy("tree", "node").collect():
            if tree == 0:
                self.base = rest[-1]
            else:
                self.trees.setdefault(tree, {})[node] = tuple(rest)

    def _arrays(self, features: Sequence[str]) -> list[tuple]:
        """Feature, edge, children and value of every tree's nodes, by the nodes' order."""
        place = {name: i for i, name in enumerate(features)}
        found = []
        for tree in self.trees.values():
            number = {node: i for i, node in enumerate(tree)}
            feature, edge, left, right, value = zip(*tree.values())
            found.append(
                (
                    np.array([-1 if f is None else place[f] for f in feature]),
                    np.array([0.0 if e is None else e for e in edge]),
                    np.array([[number.get(c, 0) for c in pair] for pair in zip(left, right)]),
                    np.array(value),
                )
            )
        return found

    def scored(self, rows: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
        """Key, log_odds and score (probability of label 1) of every row.

        The base and the trees' values are added in the order of the trees.
        """
        ship_package(rows.sparkSession)
        base, trees = self.base, self._arrays(features)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = _values(batch, features)
                odds = np.full(len(values), base)
                for tree in trees:
                    odds += tree[3][ends_of(values, tree)]
                score = 1.0 / (1.0 + np.exp(-odds))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), pa.array(odds), pa.array(score)], [key, "log_odds", "score"]
                )

        kind = rows.schema[key].dataType.simpleString()
        return rows.select(key, *features).mapInArrow(walk, f"{key} {kind}, log_odds double, score double")

    def contributions(self, rows: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
        """Key, base and one column for each feature that add up to the raw score.

        Each step from a node to its child credits the change of the node's value to the
        feature it tests; the base holds the base score and the values of the roots.
        """
        ship_package(rows.sparkSession)
        base, trees = self.base, self._arrays(features)
        for tree in trees:
            base += float(tree[3][0])
        schema = ", ".join([f"{key} {rows.schema[key].dataType.simpleString()}", "base double"]
                           + [f"{name} double" for name in features])

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = _values(batch, features)
                credit = credits_of(values, trees)
                columns = [pa.array(credit[:, i]) for i in range(len(features))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), pa.array(np.full(len(values), base)), *columns], [key, "base", *features]
                )

        return rows.select(key, *features).mapInArrow(walk, schema)


def _values(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    """Values by row and feature, missing ones as NaN."""
    columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in features]
    return np.stack(columns, axis=1).astype(np.float64)


def _child(values: np.ndarray, tree: tuple, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The nodes below: left where the value is missing or below the edge."""
    feature, edge, children, _ = tree
    own = values[rows, feature[node]]
    return children[node, (~np.isnan(own) & (own >= edge[node])).astype(np.int64)]


def ends_of(values: np.ndarray, tree: tuple) -> np.ndarray:
    """The leaf where each row ends."""
    node = np.zeros(len(values), np.int64)
    rows = np.flatnonzero(tree[0][node] >= 0)
    while len(rows):
        node[rows] = _child(values, tree, node[rows], rows)
        rows = rows[tree[0][node[rows]] >= 0]
    return node


def credits_of(values: np.ndarray, trees: Sequence[tuple]) -> np.ndarray:
    """By row and feature, the changes of the nodes' values on the row's ways down the trees."""
    found = np.zeros(values.shape)
    for tree in trees:
        feature, _, _, value = tree
        node = np.zeros(len(values), np.int64)
        rows = np.flatnonzero(feature[node] >= 0)
        while len(rows):
            own = node[rows]
            below = _child(values, tree, own, rows)
            found[rows, feature[own]] += value[below] - value[own]
            node[rows] = below
            rows = rows[feature[below] >= 0]
    return found
