"""Merkle manifest of a dataset: a hash tree whose root names every row.

A row's leaf is the SHA-256 of its fields. The leaves of one language ascend by doc_id and
are reduced in pairs, level by level (a node without a partner is hashed alone), to the
language's subroot; the subroots, ordered by language, are reduced likewise to the root. A
row's proof is its siblings from the leaf to the root: with them and the row alone, the
root can be computed again.

The tree is cut into superblocks of 1,024 (``BLOCK_LEVELS``) consecutive nodes. First every superblock is
reduced to its own node; these outer nodes, 1 for 1,024 below, make a smaller tree that
is treated the same way, until each tree has one node. Then the way back: leaves and the
outer nodes they need (one path for each superblock) are cogrouped by superblock, and
one ``applyInPandas`` finishes the local reduction, joins the local with the outer siblings
and folds the leaves up to the root. So a group holds at most 1,024 rows however large
a language is, and a lost executor costs its groups alone.

Texts are hashed where they are read; what is shuffled has about 100 bytes a row. Places
come from a range partitioning on (language, doc_id, leaf), so a language with most of the
rows is spread over all tasks.

Null fields count as ``-``; a null language is a language of its own and comes first, and
null ids come first in their language. Rows of one id are ordered by leaf, so equal rows
have equal leaves side by side, and each keeps its own proof. Empty and very long texts
are fields like any other, extra columns are not read. An empty table has no row and no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare
from tidemark.operators.ordered import global_rank
from tidemark.session import write_and_read

#: Levels of a superblock, which holds 2 to this power of nodes.
BLOCK_LEVELS = 10
#: Languages up to this number are broadcast, at under 100 bytes each.
BROADCAST_LANGS = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_ALONE, _LEFT, _RIGHT = "-", "L", "R"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(n_chars: Column | None = None) -> Column:
    """The leaf of a row, with another ``n_chars`` if given."""
    columns = {name: F.col(name) for name in FIELDS}
    if n_chars is not None:
        columns["n_chars"] = n_chars
    return F.sha2(F.concat(*map(_field, columns.values())), 256)


def levels_of(nodes: list[str], levels: int) -> list[list[str]]:
    """``nodes`` and the ``levels`` levels above them."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return found


def siblings_in(tree: list[list[str]], place: int) -> Iterator[str]:
    """Side and digest of the sibling on each level below the top; ``-`` where it is missing."""
    for level in tree[:-1]:
        other = place ^ 1
        if other < len(level):
            yield (_LEFT if other < place else _RIGHT) + level[other]
        else:
            yield _ALONE
        place >>= 1


def fold(leaf: str, siblings: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for s in siblings:
        leaf = digest(s[1:], leaf) if s[0] == _LEFT else digest(leaf, s[1:])
    return leaf


def levels_for(nodes: int, most: int) -> int:
    """Levels that reduce a run of ``nodes`` nodes to one, at most ``most``."""
    return min((int(nodes) - 1).bit_length(), most)


class _Superblock:
    """The local reduction of the rows of one superblock."""

    def __init__(self, rows: pd.DataFrame, levels: int) -> None:
        self.rows = rows.sort_values("place")
        self.size = int(rows["size"].iat[0])
        self.tree = levels_of(self.rows["node"].tolist(), levels_for(self.size, levels))
        self.number = int(self.rows["place"].iat[0]) >> levels

    def siblings(self) -> Iterator[list[str]]:
        """Of each row, in order of place."""
        return (list(siblings_in(self.tree, i)) for i in range(len(self.rows)))


_NODE = "tree long, place long, size long, node string"


def _number(levels: int) -> Column:
    return F.shiftright("place", levels).alias("block")


def outer_nodes(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The node of each superblock of ``nodes`` (tree, place, size of the tree, node)."""

    def reduced(rows: pd.DataFrame) -> pd.DataFrame:
        block = _Superblock(rows, levels)
        return pd.DataFrame(
            {
                "tree": rows["tree"].iloc[:1],
                "place": [block.number],
                "size": [-(-block.size >> levels)],
                "node": block.tree[-1],
            }
        )

    columns = [F.col(c) for c in ("tree", "place", "size", "node")]
    return nodes.select(*columns).groupBy("tree", _number(levels)).applyInPandas(reduced, _NODE)


def block_paths(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(tree, block, path, root) of each superblock of ``nodes``: the way from its node up.

    Each round has 1 node for 1,024 of the round below; 100 billion nodes take four.
    """
    outer = write_and_read(outer_nodes(nodes, levels), "merkle-outer")
    if outer.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0] > 1:
        outer = with_paths(outer, levels)
    else:
        outer = outer.withColumns({"path": F.lit(""), "root": F.col("node")})
    return outer.select("tree", F.col("place").alias("block"), "path", "root")


def with_paths(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``nodes`` with path (siblings up to the root of the tree, joined by dots) and root."""

    def joined(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = _Superblock(rows, levels)
        above = [p for p in outer["path"] if p]
        paths = [".".join([*own, *above]) for own in block.siblings()]
        found = block.rows[["tree", "place", "size", "node"]]
        return found.assign(path=paths, root=outer["root"].iat[0])

    found = (
        nodes.groupBy("tree", _number(levels))
        .cogroup(block_paths(nodes, levels).groupBy("tree", "block"))
        .applyInPandas(joined, f"{_NODE}, path string, root string")
    )
    return write_and_read(found, "merkle-paths")


def _proofs(levels: int):
    """Proof and folded root of every leaf of a superblock."""

    def proofs(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = _Superblock(rows, levels)
        above = [s for s in outer["path"].iat[0].split(".") if s]
        root = outer["root"].iat[0]
        shas, folded = [], []
        for own, shown in zip(block.siblings(), block.rows["shown"]):
            siblings = [*own, *above]
            shas.append(digest(*(s[1:] for s in siblings)))
            folded.append(fold(shown, siblings))
        return pd.DataFrame(
            {
                "doc_id": block.rows["doc_id"].tolist(),
                "leaf": block.rows["node"].tolist(),
                "subroot": outer["subroot"].iat[0],
                "root": root,
                "proof_sha256": shas,
                "folded_root": folded,
                "verified": [f == root for f in folded],
            }
        )

    return proofs


def _placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (doc_id, lang, node, shown) with tree, place and size, languages in order."""
    ranked = global_rank(leaves, [F.col("lang"), F.col("doc_id"), F.col("node")])
    langs = ranked.groupBy("lang").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("size"))
    # A language's number is its place in the order of languages.
    langs = write_and_read(global_rank(langs, [F.col("lang")], "tree", "langs"), "merkle-langs")
    if langs.count() <= BROADCAST_LANGS:
        langs = F.broadcast(langs)
    both = ranked.alias("l").join(langs.alias("g"), F.col("l.lang").eqNullSafe(F.col("g.lang")))
    return both.select(
        # As text: a null among numbers would make them floating-point numbers in pandas.
        F.col("l.doc_id").cast("string").alias("doc_id"),
        F.col("g.tree").cast("long").alias("tree"),
        (F.col("l.rank") - F.col("g.first")).alias("place"),
        F.col("g.size").cast("long").alias("size"),
        "l.node",
        "l.shown",
    )


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``docs`` has the columns ``FIELDS``. Where ``tampered`` holds, 1 is added to n_chars
    behind the manifest's back: folded_root comes from the row as it is then.
    """
    prepare(docs.sparkSession)
    leaf = leaf_of()
    # A decimal does not overflow at the largest long.
    more = leaf_of(F.col("n_chars").cast("decimal(20,0)") + 1)
    shown = leaf if tampered is None else F.when(tampered & F.col("n_chars").isNotNull(), more).otherwise(leaf)
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf.alias("node"), shown.alias("shown")
    )
    leaves = write_and_read(leaves, "merkle-leaves")
    placed = write_and_read(_placed(leaves), "merkle-placed")
    blocks = write_and_read(block_paths(placed, levels), "merkle-blocks").withColumnRenamed("root", "subroot")
    # The subroots are the nodes of one more tree above all languages.
    subroots = blocks.filter("block = 0").select(
        F.lit(0).cast("long").alias("tree"),
        (F.col("tree") - 1).alias("place"),
        F.lit(blocks.filter("block = 0").count()).cast("long").alias("size"),
        F.col("subroot").alias("node"),
    )
    tops = with_paths(subroots, levels).select(
        (F.col("place") + 1).alias("tree"), F.col("path").alias("higher"), "root"
    )
    outer = blocks.join(tops, "tree").select(
        "tree",
        "block",
        F.concat_ws(".", F.nullif("path", F.lit("")), F.nullif("higher", F.lit(""))).alias("path"),
        "subroot",
        "root",
    )
    proofs = (
        placed.groupBy("tree", _number(levels))
        .cogroup(outer.groupBy("tree", "block"))
        .applyInPandas(
            _proofs(levels),
            "doc_id string, leaf string, subroot string, root string, proof_sha256 string,"
            " folded_root string, verified boolean",
        )
    )
    return proofs.withColumn("doc_id", F.col("doc_id").cast("long"))
