import numpy as np

from tidemark.llm import language
from tidemark.llm.queries import op9_language


def plain_bundle(text):
    """Sum of bound letter vectors, one trigram at a time."""
    letters = language._letters()
    total = np.zeros(language.DIMENSIONS)
    symbols = [int(language._symbol_of()[ord(c)]) for c in f" {text.lower()} "]
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        if b:
            total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return total


def test_bundle_against_one_gram_at_a_time():
    texts = ["The cat,  sat", "", "İstanbul ñandú 日本", "x", "12 34"]
    assert np.allclose(language.bundle(texts), [plain_bundle(t) for t in texts])


def test_slices_add_up(monkeypatch):
    texts = ["many different letters in a row", "zyx wvu tsr"]
    whole = language.bundle(texts)
    monkeypatch.setattr(language, "_SLICE", 5)
    assert np.array_equal(language.bundle(texts), whole)


def test_prototypes_are_the_bundles_of_their_texts(spark):
    rows = [("the cat", "en"), ("a dog", "en"), ("der hund", "de"), (None, "fr"), ("x", None)]
    langs, vectors = language.learn_prototypes(spark.createDataFrame(rows, "text string, lang string"))
    assert langs == ["de", "en"]
    for lang, texts, vector in (("de", ["der hund"], vectors[0]), ("en", ["the cat", "a dog"], vectors[1])):
        total = sum(map(plain_bundle, texts))
        assert np.allclose(vector, total / np.linalg.norm(total)), lang


def test_held_out_accuracy(spark, folder, documents):
    found = op9_language(spark, folder).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == documents.count()
    judged = [r.lang == r.lang_pred for r in found if r.held_out]
    assert len(judged) > 40 and np.mean(judged) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_awkward_rows(awkward):
    found = language.predicted_languages(awkward).collect()
    assert len(found) == awkward.count()
    unknown = {r.doc_id for r in found if r.lang_pred == "und"}
    assert {3, 4, 5, 8} <= unknown and not {1, 2, 6, 7} & unknown
    assert all(r.score == 0 for r in found if r.lang_pred == "und")
    assert all(r.held_out for r in found if r.doc_id is None)
    kept = language.keep_identified(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == sum(r.score > 0 for r in found) >= 5


def test_nothing_learned_and_empty_table(spark, awkward, nothing):
    langs, vectors = language.learn_prototypes(nothing)
    assert langs == []
    judged = language.identify(awkward, langs, vectors).collect()
    assert {(r.lang_pred, r.score) for r in judged} == {("und", 0.0)}
    assert language.predicted_languages(nothing).collect() == []
