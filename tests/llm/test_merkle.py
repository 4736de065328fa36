import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle
from tidemark.llm.queries import op12_merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place long, tree string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row[:5]
    return h(*map(field, (doc_id, source, lang, None if n_chars is None else n_chars + more, text)))


def plain_tree(nodes):
    """Of each node the siblings up to the root as (is on the left, digest); the root."""
    proofs, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for proof, at in zip(proofs, own):
            proof.append((at % 2 == 1, nodes[at ^ 1]) if at ^ 1 < len(nodes) else (False, ""))
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        own = [at // 2 for at in own]
    return proofs, nodes[0] if nodes else None


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        parts.append((own, *plain_tree([leaf(r) for r in own])))
    above, root = plain_tree([subroot for _, _, subroot in parts])
    for (own, proofs, subroot), higher in zip(parts, above):
        for r, proof in zip(own, proofs):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, int(changed))
            for left, other in proof + higher:
                node = h(other, node) if left else h(node, other)
            shown = h(*(other for _, other in proof + higher))
            yield r[0], leaf(r), subroot, root, shown, node, node == root


def found(spark, rows, levels):
    docs = spark.createDataFrame([(*r[:5], None, "t") for r in rows], SCHEMA)
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    return merkle.manifest(docs, changed, levels).collect()


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def rows(documents):
    return [tuple(r) for r in documents.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_query(spark, folder, rows):
    result = op12_merkle(spark, folder).collect()
    assert in_order(result) == in_order(plain(rows))
    assert {r.verified for r in result} == {True, False} and len({r.root for r in result}) == 1


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_many_rounds_of_superblocks(spark, rows, levels):
    few = rows[:65] + [(1000 + i, "s", f"l{i:02}", i, "t") for i in range(20)]
    assert in_order(found(spark, few, levels)) == in_order(plain(few))


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 8, 9])
def test_small_trees(spark, count):
    few = [(i, "s", "en", i, "t") for i in range(count)]
    result = found(spark, few, 1)
    assert in_order(result) == in_order(plain(few))
    if count == 1:
        assert (result[0].root, result[0].proof_sha256) == (result[0].leaf, h())


def test_awkward_rows(spark, rows):
    few = rows[:7] + rows[:3] + rows[5:6] * 5
    few += [(None,) * 5, (None, "a", "en", 3, "x"), (None, "a", "en", 3, "x"), (7, None, "", None, "")]
    few += [(3, "s", "zz", 2**63 - 1, "é" * 100_000), (2**62 + 1, None, None, None, "9")]
    result = found(spark, few, 2)
    assert in_order(result) == in_order(plain(few)) and len(result) == len(few)


def test_awkward_table(awkward):
    assert len({r.root for r in merkle.manifest(awkward).collect()}) == 1
    assert all(r.verified for r in merkle.manifest(awkward).collect())


def test_empty_table(nothing):
    assert merkle.manifest(nothing).collect() == []


def test_a_proof_holds_for_its_row_alone():
    tree = merkle.levels_of([h(str(i)) for i in range(5)], 3)
    root = tree[-1][0]
    assert all(merkle.fold(h(str(i)), list(merkle.siblings_in(tree, i))) == root for i in range(5))
    assert merkle.fold(h("1"), list(merkle.siblings_in(tree, 0))) != root
