import itertools
import math
import random

import numpy as np

from tests.llm.conftest import document, DOCUMENTS
from tidemark.llm import decontam
from tidemark.llm.queries import op4_decontamination


def words_of(text):
    return "".join(c if c.isalnum() or ord(c) >= 128 else " " for c in (text or "").lower()).split()


def plain_overlap(doc, item):
    """Whether some diagonal has a stretch that agrees well enough, and a seed hit in it."""
    size = min(decontam.STRETCH, len(item))
    for shift in range(-len(item) + size, len(doc) - size + 1):
        low, high = max(0, -shift), min(len(item), len(doc) - shift)
        same = [doc[i + shift] == item[i] for i in range(low, high)]
        good = any(sum(same[i : i + size]) >= decontam.AGREE * size for i in range(len(same) - size + 1))
        hit = any(
            all(same[i + k] for k, used in enumerate(mask) if used == "1")
            for mask in decontam.MASKS
            for i in range(len(same) - len(mask) + 1)
        )
        if good and hit:
            return True
    return False


def plain(docs, items):
    found = set()
    listed = [(i, words_of(t)) for i, t in items]
    for doc_id, text in docs:
        words = words_of(text)
        grams = {tuple(words[i : i + 2]) for i in range(len(words))}
        for item_id, item in listed:
            if len(item) >= 11 and sum(tuple(item[i : i + 2]) in grams for i in range(len(item))) > 1:
                if plain_overlap(words, item):
                    found.add((doc_id, item_id))
    return found


def test_hashes_are_those_of_the_words_alone():
    words, begins = decontam.word_hashes(["The cat, the CAT", "", "cat"])
    assert begins.tolist() == [0, 4, 4, 5]
    assert words[0] == words[2] and words[1] == words[3] == words[4] and words[0] != words[1]


def test_query_against_every_diagonal(spark, folder, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id) for r in op4_decontamination(spark, folder).collect()}
    assert found == plain([(r.doc_id, r.text) for r in documents.collect()], items)
    assert found


def test_substitutions_are_tolerated(spark):
    rng = random.Random(2)
    item = [f"w{rng.randrange(5000)}" for _ in range(40)]
    docs = []
    for doc_id in range(30):
        passage = list(item)
        for at in rng.sample(range(40), doc_id % 6):
            passage[at] = "changed"
        filler = [f"f{rng.randrange(5000)}" for _ in range(30)]
        docs.append(document(doc_id, " ".join(filler + passage + filler)))
    docs.append(document(99, " ".join(f"f{rng.randrange(5000)}" for _ in range(300))))
    frame = spark.createDataFrame(docs, DOCUMENTS)
    benchmark = spark.createDataFrame([(1, " ".join(item)), (0, " ".join(item).upper())], "item_id long, text string")
    rows = decontam.contaminated(frame, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(d, 0) for d in range(30)}
    whole = next(r for r in rows if r.doc_id == 0)
    assert (whole.first_word, whole.last_word, whole.agreeing) == (30, 70, 40)


def test_large_filter_answers_alike():
    h = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    bits = 24
    table = np.zeros(1 << (bits - 6), np.uint64)
    for slots in decontam._slots(h, bits):
        np.bitwise_or.at(table, slots >> np.uint64(6), np.uint64(1) << (slots & np.uint64(63)))
    assert len(decontam._held(table, bits, h)) == 500
    other = h + np.uint64(12345)
    assert len(decontam._held(table, bits, other)) < 5


def test_awkward_rows(spark, awkward):
    benchmark = spark.createDataFrame(
        [(1, "the cat sat on the mat and looked at the dog"), (2, None), (3, ""), (None, "x y"), (4, "short one")],
        "item_id long, text string",
    )
    found = decontam.contaminated(awkward, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (2, 1)]
    kept = decontam.keep_clean(awkward, benchmark)
    assert kept.columns == awkward.columns
    assert kept.count() == awkward.count() - 3


def test_empty_tables(spark, awkward, nothing):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(awkward, benchmark).collect() == []
    assert decontam.keep_clean(awkward, benchmark).count() == awkward.count()
    assert decontam.keep_clean(nothing, benchmark).collect() == []


def test_every_pattern_that_agrees_gets_a_hit():
    for size in range(1, decontam.STRETCH + 1):
        masks = decontam.item_masks(size)
        for changes in range(size - math.ceil(decontam.AGREE * size - 1e-9) + 1):
            for changed in itertools.combinations(range(size), changes):
                assert any(
                    all(used == "0" or i + k not in changed for k, used in enumerate(mask))
                    for mask in masks
                    for i in range(size - len(mask) + 1)
                ), (size, changed)


def test_short_items_and_any_two_substitutions(spark):
    rng = random.Random(7)
    items = {size: [f"i{size}x{k}" for k in range(size)] for size in (1, 3, 5, 8, 10, 11, 12, 13, 20)}
    docs, expected = [], set()
    for size, item in items.items():
        allowed = min(size, 13) - math.ceil(0.8 * min(size, 13) - 1e-9)
        for changes in range(allowed + 2):
            for changed in itertools.combinations(range(min(size, 13)), changes):
                filler = [f"f{rng.randrange(5000)}" for _ in range(6)]
                passage = [w if k not in changed else "changed" for k, w in enumerate(item[:13])]
                docs.append(document(len(docs), " ".join(filler + passage + filler)))
                if changes <= allowed:
                    expected.add((docs[-1][0], size))
    benchmark = spark.createDataFrame([(n, " ".join(i)) for n, i in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, DOCUMENTS), benchmark).collect()}
    assert found == expected
