"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds the vectors of its three
letters: the first rotated by two places, the second by one, multiplied elementwise. A
text bundles (adds) its trigrams, a language the trigrams of its learning texts; a text
gets the language whose prototype has the largest cosine with it.

Trigrams are taken inside words, with one edge sign before and after each word; case is
folded; everything that is no letter separates words. a-z have a symbol each, all other
letters share 37 symbols by code point.

Null or empty texts and texts without a letter get ``und`` and score 0, as does every
text when nothing was learned. Equal cosines go to the language first in code point
order. Very long texts are bundled whole. Repeated rows get the same answer each; extra
columns pass through untouched. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_rows, held_out, prepare, row_struct

UNKNOWN = "und"
DIMENSIONS = 1024
SEED = 20240917
#: Least cosine of a text in a language, about three times what chance gives (1 / 32), and
#: the letters from which on it is asked for.
LIKENESS, FEW_LETTERS = 0.1, 30
_SYMBOLS = 64
_GRAMS = _SYMBOLS**3
#: Trigrams whose vectors are held at a time.
_SLICE = 8192
#: Languages whose counts a task holds before it passes them on.
_HELD_LANGUAGES = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    signs = np.random.default_rng(SEED).integers(0, 2, (_SYMBOLS, DIMENSIONS))
    return (signs * 2 - 1).astype(np.float32)


@lru_cache(maxsize=1)
def _symbol_of() -> np.ndarray:
    """Symbol of each code point: 0 for no letter, 1-26 for a-z, 27-63 for the others."""
    symbols = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    symbols[letters] = 27 + letters * 2654435761 % (1 << 32) % 37
    symbols[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return symbols


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    letters = _letters()
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return first[grams >> 12] * second[grams >> 6 & 63] * letters[grams & 63]


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram of each place in the texts and the number of the text it is in."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le"), np.uint32)
    symbols = _symbol_of()[points]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    kept = np.flatnonzero(symbols[1:-1] != 0) + 1
    whole = symbols.astype(np.int64)
    return whole[kept - 1] << 12 | whole[kept] << 6 | whole[kept + 1], owner[kept - 1]


def bundle(texts: list[str]) -> np.ndarray:
    """Hypervector of each text."""
    grams, owner = grams_of(texts)
    present = np.zeros(_GRAMS, bool)
    present[grams] = True
    distinct = np.flatnonzero(present)
    place = np.zeros(_GRAMS, np.int32)
    place[distinct] = np.arange(len(distinct))
    at = place[grams]
    total = np.zeros((len(texts), DIMENSIONS), np.float32)
    for low in range(0, len(distinct), _SLICE):
        part = distinct[low : low + _SLICE]
        inside = slice(None) if len(distinct) <= _SLICE else (at >= low) & (at < low + _SLICE)
        cells = owner[inside] * len(part) + at[inside] - low
        counts = np.bincount(cells, minlength=len(texts) * len(part))
        total += counts.reshape(len(texts), -1).astype(np.float32) @ gram_vectors(part)
    return total


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            grams = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts[grams])],
                ["lang", "gram", "n"],
            )
        held.clear()

    for batch, texts in arrow_rows(batches):
        langs = batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            if lang not in held and len(held) >= _HELD_LANGUAGES:
                yield from out()
            grams, _ = grams_of([t for t, own in zip(texts, langs) if own == lang])
            counts = np.bincount(grams, minlength=_GRAMS)
            held[lang] = held[lang] + counts if lang in held else counts
    yield from out()


def _bundle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        grams, counts = batch.column("gram").to_numpy(), batch.column("n").to_numpy()
        for lang in set(langs):
            own = langs == lang
            part = counts[own].astype(np.float64) @ gram_vectors(grams[own]).astype(np.float64)
            held[lang] = held.get(lang, 0.0) + part
    for lang, vector in held.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * DIMENSIONS),
                pa.array(np.arange(DIMENSIONS, dtype=np.int32)),
                pa.array(np.rint(vector).astype(np.int64)),
            ],
            ["lang", "place", "value"],
        )


def learn_prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Unit prototype of each ``lang`` from all rows of ``labelled`` (text, lang).

    Tasks add trigram counts; what reaches the driver is one vector for each language.
    Values are whole numbers, so the order of additions changes nothing.
    """
    prepare(labelled.sparkSession)
    rows = (
        labelled.select("text", "lang")
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .mapInArrow(_count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .mapInArrow(_bundle_counts, "lang string, place int, value long")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    langs = sorted({r.lang for r in rows})
    vectors = np.zeros((len(langs), DIMENSIONS))
    number = {lang: i for i, lang in enumerate(langs)}
    for r in rows:
        vectors[number[r.lang], r.place] = r.value
    lengths = np.linalg.norm(vectors, axis=1)
    return langs, vectors / np.where(lengths > 0, lengths, 1)[:, None]


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """``docs`` (any columns, ``text`` among them) as ``row`` with lang_pred and score.

    The score is the cosine with the chosen prototype, at least 0.
    """
    prepare(docs.sparkSession)
    unit = np.ascontiguousarray(prototypes.T.astype(np.float32))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow_rows(batches):
            vectors = bundle(texts)
            lengths = np.linalg.norm(vectors, axis=1)
            told = (lengths > 0) & (len(langs) > 0)
            near = vectors @ unit / np.where(lengths > 0, lengths, 1)[:, None]
            best = near.argmax(axis=1) if langs else np.zeros(len(texts), int)
            score = [float(min(max(near[i, b], 0), 1)) if t else 0.0
                     for i, (b, t) in enumerate(zip(best, told))]
            names = [langs[b] if t else UNKNOWN for b, t in zip(best, told)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names), pa.array(score, pa.float64())],
                ["row", "lang_pred", "score"],
            )

    schema = T.StructType(
        [
            T.StructField("row", docs.schema),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return docs.select(row_struct(docs).alias("row"), "text").mapInArrow(judge, schema)


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id"))).select("text", "lang")


def predicted_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from the others' lang."""
    langs, prototypes = learn_prototypes(learning_rows(docs))
    # Of the columns only the id travels with the text: lang and source are no inputs.
    judged = identify(docs.select("doc_id", "text"), langs, prototypes)
    return judged.select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score"
    )


def keep_identified(docs: DataFrame, above: float = LIKENESS, letters: int = FEW_LETTERS) -> DataFrame:
    """The documents in a known language; those without letters or unlike any go.

    Unlike are texts whose best cosine is at most ``above``, or, of fewer than ``letters``
    letters, at most 0: a sound text of a word or two may be hardly like its own language.
    """
    langs, prototypes = learn_prototypes(learning_rows(docs))
    judged = identify(docs, langs, prototypes)
    # Letters are counted in the few texts only that their cosine does not settle.
    few = F.regexp_count("row.text", F.lit(r"\p{L}")) < letters
    like = F.when(F.col("score") > above, True).when(F.col("score") > 0, few).otherwise(False)
    return judged.filter((F.col("lang_pred") != UNKNOWN) & like).select("row.*")
