import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import spelling
from tidemark.llm.queries import op13_spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_counts(docs, every, least=5):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least}


def plain_pairs(words):
    """Near pairs by comparing each word with all of about its length."""
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    return {(a, b) for a in words for d in (-1, 0, 1) for b in by_length[len(a) + d] if near(a, b)}


def plain_variants(counts):
    beside = defaultdict(list)
    for a, b in plain_pairs(counts):
        beside[a].append(b)
    forms = {}
    for w, n in counts.items():
        best = min(beside[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        yield w, forms[w], root, n, len(beside[w]), counts.get(forms[w])


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_query(spark, folder, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    counts = {w: n for w, n in plain_counts(docs, 97).items() if n >= 3}
    found = op13_spelling(spark, folder)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    result = in_order(found.collect())
    assert result == in_order(plain_variants(counts)) and any(r[1] for r in result)


def test_index_against_all_words():
    rng = random.Random(1)
    for _ in range(150):
        signs = "abÿ"[: rng.randrange(1, 4)]
        words = list({"".join(rng.choices(signs, k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 60))})
        asked = words + ["".join(rng.choices("abcÿ", k=rng.randrange(2, 9))) for _ in range(10)]
        heads = np.array([rng.randrange(len(w)) for w in asked])
        query, at = spelling.WordIndex(words).one_error(asked, heads)
        expected = [
            (i, j) for i, w in enumerate(asked) for j, v in enumerate(words) if v[: heads[i]] == w[: heads[i]] and near(w, v)
        ]
        assert sorted(zip(query.tolist(), at.tolist())) == expected


@pytest.mark.parametrize("size", [1, 2, 50])
def test_suffix_order(size):
    text = np.append(np.random.default_rng(size).integers(1, 3, size), 0)
    assert spelling.suffix_order(text).tolist() == sorted(range(size + 1), key=lambda i: text[i:].tolist())
    same = np.array([1] * size + [0])
    assert spelling.suffix_order(same).tolist() == list(range(size, -1, -1))


def test_hot_halves_are_dealt_over_blocks(spark):
    """A head and a tail that hold most of the words: blocks stay small, no pair is lost or doubled."""
    rng = random.Random(2)
    words = {"common" + "".join(rng.choices("abc", k=rng.randrange(4, 7))) for _ in range(500)}
    words |= {"".join(rng.choices("abc", k=rng.randrange(4, 7))) + "ending" for _ in range(500)}
    words |= {"".join(rng.choices("abcdef", k=rng.randrange(5, 8))) for _ in range(400)}
    counts = {w: rng.randrange(3, 200) for w in words}
    found = spelling.near_words(frame(spark, counts), block_signs=2000, half_signs=300).collect()
    pairs = [(r.word, r.near) for r in found]
    assert len(pairs) == len(set(pairs)) and set(pairs) == plain_pairs(counts)
    assert all(r.near_n == counts[r.near] for r in found)
    assert in_order(spelling.variants(frame(spark, counts), 2000, 300).collect()) == in_order(plain_variants(counts))


def test_long_chain_of_forms(spark):
    counts = {"a" * (5 + i): 3 * 2**i for i in range(40)}
    rows = {r.word: r for r in spelling.variants(frame(spark, counts)).collect()}
    assert {r.root for r in rows.values()} == {"a" * 44}
    assert rows["aaaaa"].form == "aaaaaa" and rows["a" * 44].form is None


def test_ties_and_long_words(spark):
    counts = {"house": 1, "mouse": 5, "louse": 5, "rouse": 2, "x" * 3000: 4, "x" * 2999 + "y": 9, "élève": 3, "eleve": 3}
    rows = {r.word: r for r in spelling.variants(frame(spark, counts)).collect()}
    assert rows["house"].form == "louse" and rows["house"].n_near == 3 and rows["rouse"].form == "louse"
    assert rows["mouse"].form is None and rows["mouse"].root == "mouse"
    assert rows["x" * 3000].form == "x" * 2999 + "y" and rows["élève"].n_near == 0


def test_awkward_rows(spark, awkward):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    for every in (None, 2):
        found = spelling.word_counts(awkward, every).collect()
        assert {r.word: r.n for r in found} == plain_counts(docs, every) and len(found) > 3
    counts = {w: n for w, n in plain_counts(docs, None).items() if n >= 3}
    assert in_order(spelling.spelling_variants(awkward).collect()) == in_order(plain_variants(counts))


def test_empty_table(nothing):
    assert spelling.spelling_variants(nothing).collect() == []
