"""Byte-pair encoding with word ends, and decoding.

A word's symbols form a doubly linked list. A priority queue holds the mergeable pairs of
neighbours by (merge rank, place); the first is merged, and the pairs the new symbol forms
with its neighbours are pushed. An entry whose symbols have changed since it was pushed is
stale and skipped. So a word of n signs takes n log n steps, however long it is. Decoding
joins the vocabulary's strings of the ids, with a blank between two, which is what a
tokenizer file without a decoder asks for.

What the tokenizer file says is done by the same rules: special strings are cut out of the
raw text first and are one id each; what is left is composed (NFC), lower-cased sign by
sign, cut into words by the file's pattern, and written in byte signs, the last of a word
with the word-end mark. (For code points that this Python does not know yet, the
tokenizer's own normalizer and splitter are asked; the merging stays here.) White space belongs to no word. So texts are cut at white space
first, and each worker keeps a bounded table of such pieces with their ids: pieces that
return are looked up, those not met for long are dropped.

The vocabulary is read once on the driver and broadcast; its size is that of the tokenizer
file (a few MB), whatever the number of documents. Documents are independent: no shuffle.
Null texts count as empty; an empty text has no ids and decodes to an empty text. Very long
texts are encoded whole, very long pieces pass the table by. Repeated rows get equal
answers each, a null doc_id stays null, an empty table gives no row, and extra columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from os.path import commonprefix
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import arrow_rows, prepare
from tidemark.llm.token_files import byte_letters

#: Pieces that a Python worker remembers, in about 200 bytes each, and their longest.
CACHE_PIECES = 400_000
CACHE_SIGNS = 40

_ID_BITS, _PLACE_BITS = 20, 40
_ID, _PLACE = (1 << _ID_BITS) - 1, (1 << _PLACE_BITS) - 1

# The white space of the tokenizer's pattern, by code point.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f"[^{_SPACE}]+")
_BLANK = re.compile(f"[{_SPACE}]")


class Vocabulary:
    """Ids, merge ranks and special strings of a tokenizer file, as plain tables."""

    def __init__(self, text: str) -> None:
        tokenizer = json.loads(text)
        model = tokenizer["model"]
        self.id_of: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in tokenizer["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: By left id, then right id: (rank, id of the merged symbol) as one number.
        self.merges: list[dict[int, int]] = [{} for _ in range(max(self.id_of.values()) + 1)]
        for rank, (a, b) in enumerate(pairs):
            self.merges[self.id_of[a]][self.id_of[b]] = rank << _ID_BITS | self.id_of[a + b]
        self.word_end: str = model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in (self.id_of | self.special).items()}
        split = next(p for p in tokenizer["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words: str = split["pattern"]["Regex"]


def merge(ids: list[int], merges: list[dict[int, int]]) -> list[int]:
    """``ids`` after all merges, the lowest rank first and of equal ranks the leftmost."""
    last = len(ids) - 1
    # An entry is rank, merged id and place as one number, compared in this order.
    queue = []
    for at in range(last):
        found = merges[ids[at]].get(ids[at + 1])
        if found is not None:
            queue.append(found << _PLACE_BITS | at)
    if not queue:
        return ids
    heapify(queue)
    before = list(range(-1, last))
    after = list(range(1, last + 2))
    symbols = list(ids)
    while queue:
        entry = heappop(queue)
        at, merged = entry & _PLACE, entry >> _PLACE_BITS
        right, left = after[at], symbols[at]
        if right > last or left < 0 or merges[left].get(symbols[right]) != merged:
            continue  # stale: one of the two has been merged since
        merged &= _ID
        symbols[at], symbols[right] = merged, -1
        follower = after[at] = after[right]
        if follower <= last:
            before[follower] = at
            found = merges[merged].get(symbols[follower])
            if found is not None:
                heappush(queue, found << _PLACE_BITS | at)
        left = before[at]
        if left >= 0:
            found = merges[symbols[left]].get(merged)
            if found is not None:
                heappush(queue, found << _PLACE_BITS | left)
    return [s for s in symbols if s >= 0]


class _Recent(dict):
    """A bounded table of what was met lately: a full half becomes the older one."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self._half, self._older = max(1, size // 2), {}

    def again(self, key: str):
        """What is known of ``key``, moved to the newer half; None if nothing is."""
        found = self.get(key)
        if found is None:
            found = self._older.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key: str, value) -> None:
        if len(self) >= self._half:
            self._older = dict(self)
            self.clear()
        self[key] = value


class WordEncoder:
    """Encodes texts and decodes ids by a vocabulary; keeps the pieces it has met."""

    def __init__(self, tokenizer: str, pieces: int = CACHE_PIECES) -> None:
        self._vocabulary = vocabulary = Vocabulary(tokenizer)
        self._newer = Tokenizer.from_str(tokenizer)
        self._words = regex.compile(vocabulary.words)
        # The same for ASCII pieces without white space, by the plain engine.
        plain = vocabulary.words.replace("\\p{L}", "a-z").replace("\\p{N}", "0-9").replace("\\s", "")
        self._plain_words = re.compile(plain)
        letters = byte_letters()
        self._byte_of = {c: b for b, c in enumerate(letters)}
        self._inner = [vocabulary.id_of[c] for c in letters]
        self._final = [vocabulary.id_of[c + vocabulary.word_end] for c in letters]
        special = sorted(vocabulary.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        # What all special strings begin with; a text without it holds none.
        self._special_start = commonprefix(special)
        self._known = _Recent(pieces)
        self._raw = _Recent(pieces)

    def _word_ids(self, word: str) -> list[int]:
        found = self._known.again(word)
        if found is None:
            raw = word.encode()
            found = merge([*(self._inner[b] for b in raw[:-1]), self._final[raw[-1]]], self._vocabulary.merges)
            if len(word) <= CACHE_SIGNS:
                self._known.keep(word, found)
        return found

    def _split(self, text: str) -> list[str]:
        """The words of a text without special strings, composed and lower-cased."""
        if text.isascii():
            lowered = text.lower()
            if lowered.isalpha():
                return [lowered]
            return (self._words if _BLANK.search(lowered) else self._plain_words).findall(lowered)
        if any(unicodedata.category(c) == "Cn" for c in text):
            normal = self._newer.normalizer.normalize_str(text)
            cut = self._newer.pre_tokenizer.pre_tokenize_str(normal)
            return [bytes(self._byte_of[c] for c in word).decode() for word, _ in cut]
        composed = unicodedata.normalize("NFC", text)
        # Sign by sign: the rule for a sigma at the end of a word is not wanted.
        return self._words.findall(composed.replace("Σ", "σ").lower())

    def _plain_ids(self, text: str) -> list[int]:
        words = self._split(text)
        if len(words) == 1:
            return self._word_ids(words[0])
        return [i for word in words for i in self._word_ids(word)]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        if self._special is None or self._special_start not in text or not self._special.search(text):
            return self._plain_ids(text)
        ids: list[int] = []
        for n, part in enumerate(self._special.split(text)):
            ids += [self._vocabulary.special[part]] if n % 2 else self._plain_ids(part)
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ``ids``; ids outside the vocabulary give nothing."""
        strings = self._vocabulary.strings
        try:
            return " ".join(map(strings.__getitem__, ids))
        except KeyError:
            return " ".join([strings[i] for i in ids if i in strings])

    def _piece(self, piece: str) -> bytes:
        """Ids, as little-endian numbers of 32 bits, of a piece without white space."""
        found = self._raw.again(piece)
        if found is None:
            ids = self.encode(piece)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= CACHE_SIGNS:
                self._raw.keep(piece, found)
        return found

    def encode_raw(self, text: str) -> bytes:
        """Ids of a whole text as little-endian numbers of 32 bits."""
        pieces = _PIECES.findall(text)
        found = list(map(self._raw.get, pieces))
        if None in found:
            more = self._piece
            found = [more(piece) if f is None else f for f, piece in zip(found, pieces)]
        return b"".join(found)

    def decode_raw(self, raw: bytes) -> str:
        return self.decode(struct.unpack(f"<{len(raw) // 4}I", raw))


@lru_cache(maxsize=1)
def _encoder(tokenizer: str) -> WordEncoder:
    return WordEncoder(tokenizer)


def encode_and_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs`` (doc_id, text) with n_tokens, ids_sha256 and decoded_sha256, one row each."""
    spark = prepare(docs.sparkSession)
    shipped = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        for batch, texts in arrow_rows(batches):
            raw = [encoder.encode_raw(t) for t in texts]
            decoded = [encoder.decode_raw(r).encode() for r in raw]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(r) // 4 for r in raw], pa.int64()),
                    pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in decoded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        judge, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
