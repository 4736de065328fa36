"""Spelling variants: words one edit apart, found with bidirectional FM-index search schemes.

Two words are near if one inserted, deleted or replaced code point turns one into the
other. Cut a word into two halves: the edit leaves one of them whole. So a word is
searched twice, once for each half: the half is matched exactly, then extended across the
other half with exactly one error. The text searched is the vocabulary with a delimiter
before and after each word. A search holds an interval of suffix ranks of this text and,
in step with it, one of the reversed text; so a match grows at either end, and an interval
under both delimiters is one word.

Words meet by their halves. A word is indexed under each half at which a word one
code point shorter, as long or longer could be cut (two for each side), and searched
under its own two. Halves are dealt by hash into blocks of about ``BLOCK_SIGNS`` signs,
each with an index of its own, built and dropped in its task. Words of a half with more
than ``HALF_SIGNS`` signs are dealt over several blocks, and the searches of that half go
to all of these; so no block grows with the vocabulary, and every pair is still met.
A pair that both searches of a word would find is kept by the first half's.

Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased.
Tasks add up what they read before the counts are shuffled, a frequent word included. A
null text has no words, a null doc_id counts as an empty one. Very long texts are
read whole, very long words are searched like others. Ties of the largest count go to the
word first in code-point order; repeated rows count each. Extra columns are not read, an
empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare
from tidemark.session import write_and_read

LEAST_SIGNS = 5
LEAST_COUNT = 3
#: A word's form must be this many times as frequent.
TIMES = 2
#: Signs of the words of a block, and of a half's words before they are dealt over blocks.
BLOCK_SIGNS = 400_000
HALF_SIGNS = 100_000
#: Halves with that many signs are broadcast up to this number, at 16 bytes each.
BROADCAST_HALVES = 100_000
#: Words that a task adds up before it passes them on.
_HELD_WORDS = 150_000
#: Searches taken at a time.
_SEARCHES = 20_000

_SENTINEL, _DELIMITER = 0, 1


def runs_of(text: str, least: int) -> list[str]:
    """Runs of at least ``least`` letters, A-Z in lower case."""
    return re.findall(f"[a-zÀ-ÿ]{{{least},}}", text.encode().lower().decode())


def spoilt(run: str, check: int, every: int) -> str:
    """``run`` without one sign if ``every`` divides its check number."""
    if check % every:
        return run
    at = check % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, every: int | None = None, least: int = LEAST_SIGNS) -> DataFrame:
    """(word, n) of the words of at least ``least`` signs in ``docs`` (doc_id, text).

    With ``every`` a run loses a sign where that divides the CRC-32 of doc_id and run.
    """
    prepare(docs.sparkSession)

    def batch_of(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = Counter(runs_of(text, least))
                if every is None:
                    held.update(own)
                else:
                    start = zlib.crc32(f"{doc_id}:".encode())
                    for run, n in own.items():
                        word = spoilt(run, zlib.crc32(run.encode(), start), every)
                        if len(word) >= least:
                            held[word] += n
                if len(held) >= _HELD_WORDS:
                    yield batch_of(held)
                    held.clear()
        yield batch_of(held)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    counted = rows.filter("text is not null").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the sorted suffixes of ``text``, whose last sign is the only 0.

    Ranks by the first signs, packed into one number, are doubled in reach until no two
    suffixes share one.
    """
    size, bits = len(text), int(text.max()).bit_length() + 1
    reach = 62 // bits
    padded = np.concatenate([text.astype(np.int64), np.zeros(reach, np.int64)])
    keys = np.zeros(size, np.int64)
    for i in range(reach):
        keys = keys << bits | padded[i : i + size]
    while True:
        order = np.argsort(keys)
        steps = np.diff(keys[order]) != 0
        if steps.all():
            return order
        ranks = np.empty(size, np.int64)
        ranks[order] = np.concatenate([[0], np.cumsum(steps)])
        keys = ranks * (size + 1)
        keys[: max(size - reach, 0)] += ranks[reach:] + 1
        reach *= 2


class _Ranks:
    """Ranks in the Burrows-Wheeler transform of a text, as a wavelet matrix."""

    def __init__(self, text: np.ndarray, order: np.ndarray, signs: int) -> None:
        left = text[order - 1]
        counts = np.bincount(text, minlength=signs)
        self._first = np.cumsum(counts) - counts
        self._levels = []
        for level in reversed(range(signs.bit_length())):
            ones = left >> level & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~ones)])
            self._levels.append((level, zeros, zeros[-1]))
            left = np.concatenate([left[~ones], left[ones]])
        self._begin = np.zeros(signs, np.int64)
        present, at = np.unique(left, return_index=True)
        self._begin[present] = at

    def step(self, low, high, sign):
        """Of each interval: that of the suffixes with ``sign`` in front, and how many have a smaller one."""
        smaller = np.zeros(len(low), np.int64)
        for level, zeros, total in self._levels:
            one = sign >> level & 1 == 1
            below, above = zeros[low], zeros[high]
            smaller += np.where(one, above - below, 0)
            low = np.where(one, total + low - below, below)
            high = np.where(one, total + high - above, above)
        begin = self._first[sign] + low - self._begin[sign]
        return begin, high - low, smaller

    def steps(self, low, high):
        """``step`` for every sign that stands in front: (place of the interval, sign, begin, size, smaller)."""
        owner = np.arange(len(low))
        smaller = np.zeros(len(low), np.int64)
        sign = np.zeros(len(low), np.int64)
        for level, zeros, total in self._levels:
            below, above = zeros[low], zeros[high]
            with_zero, with_one = above > below, high - low > above - below
            owner = np.concatenate([owner[with_zero], owner[with_one]])
            sign = np.concatenate([sign[with_zero], sign[with_one] | 1 << level])
            smaller = np.concatenate([smaller[with_zero], (smaller + above - below)[with_one]])
            low = np.concatenate([below[with_zero], (total + low - below)[with_one]])
            high = np.concatenate([above[with_zero], (total + high - above)[with_one]])
        return owner, sign, self._first[sign] + low - self._begin[sign], high - low, smaller


class WordIndex:
    """Bidirectional FM-index of different words between delimiters."""

    def __init__(self, words: list[str]) -> None:
        points = np.frombuffer(("\x01" + "\x01".join(words) + "\x01").encode("utf-32-le"), np.uint32)
        self._alphabet, signs = np.unique(points, return_inverse=True)
        text = np.append(signs + 1, _SENTINEL)
        back = np.append(text[-2::-1], _SENTINEL)
        kinds = len(self._alphabet) + 2  # and the sentinel, and one for signs that no word has
        self._size = len(text)
        self._order = suffix_order(text)
        self._ahead = _Ranks(text, self._order, kinds)
        self._behind = _Ranks(back, suffix_order(back), kinds)
        self._delimiters = np.flatnonzero(text == _DELIMITER)

    def _signs(self, words: list[str]) -> np.ndarray:
        """Signs of the words, each with the delimiter behind it."""
        points = np.frombuffer(("\x01".join(words) + "\x01").encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self._alphabet, points)
        known = self._alphabet[np.minimum(at, len(self._alphabet) - 1)] == points
        return np.where(known, at, len(self._alphabet)) + 1

    def one_error(self, words: list[str], heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``words``, place in the index) of words that begin with the same
        ``heads`` signs and are one edit apart behind them."""
        signs = self._signs(words)
        lengths = np.array([len(w) for w in words])
        starts = np.cumsum(lengths + 1) - lengths - 1
        query = np.arange(len(words))
        low, other, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), self._size)
        # The head, from its last sign to its first, then the delimiter in front of it.
        for back in range(1, int(heads.max(initial=0)) + 2):
            open_ = np.flatnonzero(heads[query] + 1 >= back)
            of = query[open_]
            sign = np.where(heads[of] >= back, signs[starts[of] + np.maximum(heads[of] - back, 0)], _DELIMITER)
            begin, left, smaller = self._ahead.step(low[open_], low[open_] + size[open_], sign)
            low[open_], size[open_] = begin, left
            other[open_] += smaller
            kept = size > 0
            query, low, other, size = query[kept], low[kept], other[kept], size[kept]
        exact = (query, heads[query], low, other, size)
        wrong = tuple(np.zeros(0, np.int64) for _ in range(5))
        found = []
        first = True
        while len(exact[0]) or len(wrong[0]):
            exact, more = self._branch(exact, signs, starts, lengths, first)
            first = False
            query, at, low, other, size = map(np.concatenate, zip(wrong, *more))
            begin, size, smaller = self._behind.step(other, other + size, signs[starts[query] + at])
            low = low + smaller
            ended = (size > 0) & (at == lengths[query])
            found.append((query[ended], low[ended]))
            kept = (size > 0) & ~ended
            wrong = (query[kept], at[kept] + 1, low[kept], begin[kept], size[kept])
        query, low = map(np.concatenate, zip((wrong[0], wrong[0]), *found))
        return query, np.searchsorted(self._delimiters, self._order[low])

    def _branch(self, exact, signs, starts, lengths, first):
        """The states without an error one sign on, and those that the first error makes of them."""
        query, at, low, other, size = exact
        owner, sign, begin, left, smaller = self._behind.steps(other, other + size)
        of, place = query[owner], at[owner]
        grown = (of, place, low[owner] + smaller, begin, left)
        inside = place < lengths[of]
        right = (sign == signs[starts[of] + place]) & inside
        strange = (sign > _DELIMITER) & (sign != signs[starts[of] + place])
        replaced = [a[strange & inside] for a in grown]
        replaced[1] = replaced[1] + 1
        added = [a[strange] for a in grown]
        # In a run of one sign, only the first can be left out.
        drop = at < lengths[query]
        if not first:
            drop &= signs[starts[query] + at] != signs[starts[query] + at - 1]
        left_out = [a[drop] for a in exact]
        left_out[1] = left_out[1] + 1
        on = [a[right] for a in grown]
        on[1] = on[1] + 1
        return tuple(on), (replaced, added, left_out)


def _pairs_in(block: pa.Table) -> pa.Table:
    """Pairs of one block, whose halves are all heads or all tails.

    A word may stand in a block under two halves, and be searched for several parts of
    its half at once: it counts once, and only for words under the half it is searched by.
    """
    tails = block.column("side")[0].as_py() == 1
    words, counts = block.column("word").to_pylist(), block.column("n").to_pylist()
    units = block.column("unit").to_pylist()
    place: dict[str, int] = {}
    under = np.zeros((len(words), 2), np.int64)
    known_n = []
    for i in np.flatnonzero(block.column("indexed").to_numpy()).tolist():
        at = place.setdefault(words[i], len(place))
        if at == len(known_n):
            known_n.append(counts[i])
            under[at] = units[i]
        else:
            under[at, 1] = units[i]
    known = list(place)
    searched = {words[i]: units[i] for i in np.flatnonzero(block.column("searched").to_numpy()).tolist()}
    asked, by = list(searched), np.array(list(searched.values()), np.int64)
    # A tail is the head of the reversed word.
    turn = (lambda w: w[::-1]) if tails else (lambda w: w)
    index = WordIndex([turn(w) for w in known]) if known else None
    own, near, near_n = [], [], []
    for low in range(0, len(asked) if known else 0, _SEARCHES):
        part = asked[low : low + _SEARCHES]
        query, at = index.one_error([turn(w) for w in part], np.array([(len(w) + tails) // 2 for w in part]))
        kept = (under[at] == by[low + query, None]).any(axis=1)
        for q, a in zip(query[kept].tolist(), at[kept].tolist()):
            word, other = part[q], known[a]
            if not tails or not other.startswith(word[: len(word) // 2]):
                own.append(word)
                near.append(other)
                near_n.append(known_n[a])
    return pa.table(
        {"word": pa.array(own, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array(near_n, pa.int64())}
    )


def _under_halves(words: DataFrame) -> DataFrame:
    """``words`` (word, n) under each half: side (0 head, 1 tail), unit (hash of it) and own."""
    size = F.char_length("word")

    def halves(side: int) -> Column:
        own = F.expr(f"(char_length(word) + {side}) div 2")
        lengths = F.array_distinct(F.array(*(F.expr(f"(char_length(word) + {side + d}) div 2") for d in (-1, 0, 1))))
        return F.transform(
            lengths,
            lambda k: F.struct(
                F.lit(side).alias("side"),
                F.xxhash64(
                    F.lit(side), F.substr("word", F.when(F.lit(side == 0), F.lit(1)).otherwise(size - k + 1), k)
                ).alias("unit"),
                (k == own).alias("own"),
            ),
        )

    return words.select("word", "n", (size + 1).alias("signs"), F.explode(F.concat(halves(0), halves(1))).alias("h")).select(
        "word", "n", "signs", "h.*"
    )


def near_words(words: DataFrame, block_signs: int = BLOCK_SIGNS, half_signs: int = HALF_SIGNS) -> DataFrame:
    """All pairs (word, near, near_n) of ``words`` (word, n; different words) one edit apart."""
    prepare(words.sparkSession)
    rows = _under_halves(words)
    units = rows.groupBy("unit").agg(F.sum("signs").alias("signs"))
    units = write_and_read(units.filter(F.col("signs") > half_signs), "spelling-halves")
    parts = units.select("unit", F.ceil(F.col("signs") / half_signs).cast("int").alias("parts"))
    if units.count() <= BROADCAST_HALVES:
        parts = F.broadcast(parts)
    total = rows.agg(F.coalesce(F.sum("signs"), F.lit(0))).first()[0]
    own_part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    dealt = (
        rows.join(parts, "unit", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own_part", own_part)
        .withColumn(
            "part",
            F.explode(
                F.when(F.col("own"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own_part"))
            ),
        )
        .select(
            "side",
            "unit",
            F.pmod(F.xxhash64("unit", "part"), F.lit(max(1, -(-total // block_signs)))).alias("block"),
            "word",
            "n",
            (F.col("part") == F.col("own_part")).alias("indexed"),
            F.col("own").alias("searched"),
        )
    )
    return dealt.groupBy("side", "block").applyInArrow(_pairs_in, "word string, near string, near_n long")


def _last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form; each round doubles the steps followed."""
    links = write_and_read(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not links.filter("moved").isEmpty():
        after = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(after, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        links = write_and_read(links, "spelling-roots")
    return links.select("word", "root")


def variants(words: DataFrame, block_signs: int = BLOCK_SIGNS, half_signs: int = HALF_SIGNS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every one of ``words`` (word, n).

    The form is the near word of largest n, if that is at least ``TIMES`` the word's; the
    root is where the forms, followed from the word, end. Counts at least double from form
    to form, so few rounds reach it.
    """
    pairs = near_words(words, block_signs, half_signs)
    both = pairs.select("word", F.lit(None).cast("long").alias("n"), "near", "near_n").unionByName(
        words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    )
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    judged = both.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.less") >= TIMES * F.col("n")
    judged = judged.select(
        "word",
        "n",
        "n_near",
        F.when(frequent, F.col("best.near")).alias("form"),
        F.when(frequent, -F.col("best.less")).alias("form_n"),
    )
    judged = write_and_read(judged, "spelling-forms")
    roots = _last_forms(judged.filter("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, every: int | None = None) -> DataFrame:
    """``variants`` of the words of ``docs`` (doc_id, text) that occur ``LEAST_COUNT`` times."""
    words = word_counts(docs, every).filter(F.col("n") >= LEAST_COUNT)
    return variants(write_and_read(words, "spelling-words"))
