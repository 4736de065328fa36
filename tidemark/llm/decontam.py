"""Benchmark decontamination with spaced seeds.

A mask is a fixed pattern of word positions that count; the others are ignored, so two
passages that differ in an ignored word still get the same hash. Every window of every
document and of every benchmark item is hashed under each mask. Hashes that may occur in
the benchmark (a Bloom filter of bounded size tells) go into an equality join with it.
Around each joined hit the two passages are laid side by side, without gaps, and compared
word by word: a document holds a passage when a stretch of ``STRETCH`` words (or the
whole item, if shorter) agrees in at least 80% of its words.

The masks are chosen so that every stretch that agrees well enough holds a hit, wherever its
words differ. Items shorter than a stretch have further masks by their number of words, and
documents are hashed under those only if the benchmark has such items; of up to four words
all must agree.

Words are lower-cased runs of letters, digits and non-ASCII characters. Null and empty
texts hold nothing. Repeated items with equal words count as the one with the smallest
id. Rows with one doc_id are told apart by a hash of the row. Very long texts are hashed
whole; ties and repeated documents get equal answers each. Extra columns pass through, an
empty table of either kind finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, prepare, row_key, row_struct
from tidemark.session import write_and_read

#: Masks of weight 7. Of 13 words, any two may differ.
MASKS = ("11011010011", "110010110101", "101101100101", "1011001111", "1101110011")
#: Masks besides those, for items of so many words: two may differ from 10 on, one from 5 on.
ITEM_MASKS = {
    **{n: ("1" * n,) for n in range(1, 5)},
    5: ("11101", "10111", "11011", "1111"),
    6: ("110011", "1111", "101101"),
    7: ("1100111", "11111", "1110011"),
    8: ("11000111", "11111", "1110011"),
    9: ("111000111", "111111"),
    10: ("110111", "111000101", "10101011"),
    11: ("11110101001", "10111111", "11101010101", "1100110111", "10111100011"),
    12: ("11110101001", "100001111011"),
}
STRETCH = 13
AGREE = 0.8
#: Bits of the filter for each benchmark hash, and the most and fewest bits (2**n).
_FILTER_SHARE, _FILTER_MOST, _FILTER_LEAST = 32, 27, 22
#: Hits at most so many words apart share a segment; so many words are added around it.
_JOIN_WITHIN, _AROUND = 32, 24
_BASE = 0x9E3779B97F4A7C15 | 1
_WRAP = (1 << 64) - 1
_WINDOW = 11


@lru_cache(maxsize=1)
def _word_bytes() -> np.ndarray:
    """Marks bytes that belong to words: ASCII letters and digits, and all of non-ASCII."""
    return np.array([chr(b).isalnum() or b >= 128 for b in range(256)])


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    found = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(size + 1, base, np.uint64)
        factors[0] = 1
        found.append(np.cumprod(factors))
    return found[0], found[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and where each text's words begin (and end)."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    inside = _word_bytes()[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    # Sizes of ordinary batches share one table; a very long text has one of its own.
    size = 1 << max(20, int(len(data)).bit_length())
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        summed = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=summed[1:])
        words = _mix((summed[ends] - summed[starts]) * inverse[starts])
    begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
    return words, np.searchsorted(starts, begins)


def item_masks(size: int) -> list[str]:
    """Masks of an item with so many words."""
    return [m for m in (*MASKS, *ITEM_MASKS.get(size, ())) if len(m) <= size]


def seed_hashes(words: np.ndarray, masks: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(mask as a number, hash of the window at every place) over a run of words."""
    for mask in masks:
        number = int(mask, 2)
        places = len(words) - len(mask) + 1
        if places <= 0:
            yield number, np.zeros(0, np.uint64)
            continue
        total = np.full(places, number, np.uint64)
        with np.errstate(over="ignore"):
            for k, used in enumerate(mask):
                if used == "1":
                    total += words[k : k + places] * np.uint64((_BASE * (2 * k + 3)) & _WRAP | 1)
            yield number, _mix(total)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in arrow_rows(batches):
        words, begins = word_hashes(texts)
        own = [words[a:b].view(np.int64) for a, b in zip(begins, begins[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), pa.array(own, pa.list_(pa.int64()))], ["item_id", "words"]
        )


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, words in zip(batch.column("item_id"), batch.column("words")):
            run = np.asarray(words.values.to_numpy(zero_copy_only=False)).view(np.uint64)
            for _, h in seed_hashes(run, item_masks(len(run))):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)),
                        pa.array([item.as_py()] * len(h), pa.int64()),
                        pa.array(np.arange(len(h), dtype=np.int32)),
                    ],
                    ["h", "item_id", "item_at"],
                )


def benchmark_index(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with their words, seed hashes of the items), written once."""
    prepare(benchmark.sparkSession)
    items = write_and_read(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
        .mapInArrow(_item_rows, "item_id long, words array<long>")
        .filter(F.size("words") > 0)
        .groupBy("words")
        .agg(F.min("item_id").alias("item_id"))
        .withColumn("item", F.xxhash64("words"))
        .select("item", "item_id", "words"),
        "benchmark-items",
    )
    seeds = items.select(F.col("item").alias("item_id"), "words").mapInArrow(
        _item_seeds, "h long, item_id long, item_at int"
    ).withColumnRenamed("item_id", "item")
    return items, write_and_read(seeds, "benchmark-seeds")


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of a hash in a filter of 2**bits bits."""
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        again = h * np.uint64(_BASE)
        return [h >> shift, again >> shift, (again ^ (h << np.uint64(17))) * np.uint64(_BASE) >> shift]


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """Bloom filter of the benchmark's hashes: at most 16 MB, however many there are."""
    count = seeds.count()
    bits = min(max((count * _FILTER_SHARE).bit_length(), _FILTER_LEAST), _FILTER_MOST)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            slots = np.unique(np.concatenate(_slots(h, bits)))
            masks = np.uint64(1) << (slots & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array((slots >> np.uint64(6)).astype(np.int32)), pa.array(masks.view(np.int64))],
                ["word", "mask"],
            )

    rows = (
        seeds.select("h").mapInArrow(words_of, "word int, mask long")
        .groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    )
    held = np.zeros(1 << (bits - 6), np.int64)
    held[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)
    return np.unpackbits(held.view(np.uint8), bitorder="little").view(bool) if bits <= 22 else held.view(np.uint64), bits


def _held(table: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter may hold."""
    found = np.arange(len(h))
    for k in range(3):
        slots = _slots(h[found], bits)[k]
        if table.dtype == bool:
            hit = table[slots]
        else:
            hit = table[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1) != 0
        found = found[hit]
    return found


def _segments(docs: DataFrame, filter_: np.ndarray, bits: int, masks: list[str]) -> DataFrame:
    """Stretches of the documents with seed hits: their words, and the hits in them."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch, texts in arrow_rows(batches, chars=1 << 18):
            words, begins = word_hashes(texts)
            at, value = [], []
            for _, h in seed_hashes(words, masks):
                hit = _held(table, bits, h)
                at.append(hit)
                value.append(h[hit])
            at, value = np.concatenate(at), np.concatenate(value)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, value = at[order], value[order]
            owner = np.searchsorted(begins, at, side="right") - 1
            cut = np.flatnonzero((owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > _JOIN_WITHIN)) + 1
            rows = []
            for low, high in zip([0, *cut], [*cut, len(at)]):
                doc = owner[low]
                start = max(begins[doc], at[low] - _AROUND)
                end = min(begins[doc + 1], at[high - 1] + _WINDOW + _AROUND)
                rows.append((doc, start - begins[doc], words[start:end].view(np.int64),
                             value[low:high].view(np.int64), (at[low:high] - start).astype(np.int32)))
            take = pa.array([int(r[0]) for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take),
                    batch.column("content").take(take),
                    pa.array([int(r[1]) for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[4] for r in rows], pa.list_(pa.int32())),
                ],
                ["doc_id", "content", "start", "words", "hashes", "places"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("content"), "text"
    ).mapInArrow(
        find,
        "doc_id long, content long, start long, words array<long>, hashes array<long>, places array<int>",
    )


def best_stretch(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int]:
    """(start, end, agreeing words, needed) of the best stretch; ``words[i + shift]`` meets ``item[i]``."""
    low, high = max(0, -shift), min(len(item), len(words) - shift)
    size = min(STRETCH, len(item))
    need = int(np.ceil(AGREE * size - 1e-9))
    if high - low < size:
        return 0, 0, 0, need
    same = np.concatenate([[0], np.cumsum(words[low + shift : high + shift] == item[low:high])])
    agree = same[size:] - same[:-size]
    good = np.flatnonzero(agree >= need)
    if not len(good):
        return 0, 0, int(agree.max()), need
    # From the first to the last good stretch in reach of the hit.
    start, end = int(good[0]), int(good[-1]) + size
    return low + shift + start, low + shift + end, int(same[end] - same[start]), need


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        found = [
            best_stretch(np.asarray(w), np.asarray(i), s)
            for w, i, s in zip(part["words"], part["item_words"], part["shift"])
        ]
        out = part[["doc_id", "content", "item_id"]].copy()
        out["first_word"] = [s + f[0] for s, f in zip(part["start"], found)]
        out["last_word"] = [s + f[1] for s, f in zip(part["start"], found)]
        out["agreeing"] = [f[2] for f in found]
        yield out[[f[1] > f[0] and f[2] >= f[3] for f in found]]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item of which it holds a passage.

    doc_id, content (hash of the row), item_id, first_word, last_word (exclusive) and
    agreeing: word places of the largest verified stretch and its agreeing words.
    """
    prepare(docs.sparkSession)
    items, seeds = benchmark_index(benchmark)
    filter_, bits = seed_filter(seeds)
    short = items.select(F.size("words").alias("size")).filter(F.col("size") < STRETCH).distinct().collect()
    masks = list(dict.fromkeys([*MASKS, *(m for row in short for m in ITEM_MASKS[row["size"]])]))
    segments = write_and_read(_segments(docs, filter_, bits, masks), "seed-segments")
    hits = segments.select(
        "doc_id", "content", "start", F.explode(F.arrays_zip("hashes", "places")).alias("hit")
    ).select("doc_id", "content", "start", F.col("hit.hashes").alias("h"), F.col("hit.places").alias("place"))
    meetings = (
        hits.join(seeds, "h")
        .select("doc_id", "content", "start", "item", (F.col("place") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    same_segment = [
        F.col("m.doc_id").eqNullSafe(F.col("s.doc_id")),
        F.col("m.content") == F.col("s.content"),
        F.col("m.start") == F.col("s.start"),
    ]
    # Equal rows give equal segments; one of them is enough.
    distinct_segments = segments.select("doc_id", "content", "start", "words").dropDuplicates(
        ["doc_id", "content", "start"]
    )
    laid = (
        meetings.alias("m")
        .join(distinct_segments.alias("s"), same_segment)
        .select("m.*", "s.words")
        .join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
        .select("doc_id", "content", "start", "words", "item_id", "item_words", "shift")
    )
    verified = laid.mapInPandas(
        _verify,
        "doc_id long, content long, item_id long, first_word long, last_word long, agreeing long",
    )
    return (
        verified.groupBy("doc_id", "content", "item_id")
        .agg(F.max(F.struct("agreeing", F.negative("first_word").alias("before"), "last_word")).alias("b"))
        .select(
            "doc_id",
            "content",
            "item_id",
            F.negative("b.before").alias("first_word"),
            "b.last_word",
            "b.agreeing",
        )
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, last_word, agreeing of every passage found."""
    return overlaps(docs, benchmark).drop("content")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of the benchmark."""
    found = write_and_read(overlaps(docs, benchmark).select("doc_id", "content").distinct(), "leaking")
    rows = docs.select(
        row_struct(docs).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key(docs).alias("content"),
    )
    return (
        rows.alias("d")
        .join(
            found.alias("f"),
            F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.content") == F.col("f.content")),
            "left_anti",
        )
        .select("row.*")
    )
