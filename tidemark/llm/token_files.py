"""Token-ID files: documents as lists of token ids in Parquet.

A folder holds ``tokens/`` and ``parts/``. ``tokens/`` has a file for each range of
doc_id, in ascending order: part (number of the range), doc_id, offset (ids before the
document within its part), n_tokens, tokens (list of int). Ids are dictionary-coded,
the ascending numbers delta-coded; row groups and pages have set sizes and carry page
indexes, so a reader of a few documents opens few pages, and a reader of metadata no
tokens. ``parts/`` has each part's first id place in the whole.

Documents are encoded whole with the ``tokenizers`` library and end with an end id.
Special strings in a text get what the tokenizer file gives them. Null texts count as
empty and hold the end id alone; null doc_ids come first. Rows with one doc_id stay
apart, ordered by text; extra columns are not written. Very long texts are encoded whole,
piece by piece. An empty table gives files without rows.

How a text is encoded: the pre-tokenizer never joins what stands on both sides of a
blank that follows a character other than white space, so a text is cut there and each
piece's ids are taken from a bounded table of pieces met before. The result is the one
of encoding the text in one call; the tests compare both.
"""

from __future__ import annotations

import re
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import arrow_rows, prepare
from tidemark.session import run_dir

END_ID = 2
#: Pieces whose ids a Python worker remembers, in about 50 bytes each.
CACHE_PIECES = 400_000
#: Other texts it remembers, in about 250 bytes each.
_CACHE_OTHERS = 1 << 16
_ROW_GROUP_BYTES = 32 << 20
_PAGE_BYTES = 256 << 10
_PAGE_ROWS = 2000
#: White space of any reading, and the places where a blank follows it.
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) + "\u180e"
_CUT = re.compile(f"(?<![{_SPACES}])(?= )")


_PROBES = 8
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of ASCII letters.
_LETTERS = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def byte_letters() -> str:
    """The signs a byte-level vocabulary writes for the bytes, in their order.

    Bytes that print in Latin-1 stand for themselves, the others, in order, for the
    signs from 256 on.
    """
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in prints]
    return "".join(chr(b if b in prints else 256 + others.index(b)) for b in range(256))


class Encoder:
    """Ids of many texts at a time.

    Pieces behind a blank are looked up all at once in a hash table kept in arrays: a
    piece of up to 23 bytes is its own key (three numbers, the length in the last byte),
    so equal keys are equal pieces. Ids of all known pieces lie in one pool. A full table
    is emptied and filled anew.
    """

    def __init__(self, path: str, end_id: int = END_ID, pieces: int = CACHE_PIECES) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._letters = byte_letters()
        self._blank = self._letters[ord(" ")]
        self._cut = self._tokenizer.model.tokenize
        self._end_id, self._pieces = end_id, pieces
        self._slots = 1 << max(10, (2 * pieces).bit_length())
        self._clear()

    def _clear(self) -> None:
        self._table = np.zeros(self._slots, np.int32)
        self._keys = np.zeros((3, self._pieces + 1), np.uint64)
        self._offsets = np.zeros(self._pieces + 1, np.int64)
        self._counts = np.zeros(self._pieces + 1, np.int64)
        self._entries = 0
        self._pool = np.zeros(1 << 16, np.uint32)
        self._filled = 0
        self._others: dict[str, tuple[int, int]] = {}
        self._end = self._store([self._end_id])
        self._marks = {ord(c): self._store(self._ids(c)) for c in ".,"}

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _piece_ids(self, piece: str) -> list[int]:
        """Ids of a blank and the piece behind it."""
        if not piece.isalpha():
            return self._ids(" " + piece)
        # Letters behind a blank are one pre-token: the model alone is asked, in the
        # signs of its vocabulary, which saves the splitting.
        if not piece.isascii():
            piece = charmap_decode(piece.encode(), "strict", self._letters)[0]
        return [token.id for token in self._cut(self._blank + piece)]

    def _store(self, ids: list[int]) -> tuple[int, int]:
        begin, self._filled = self._filled, self._filled + len(ids)
        if self._filled > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros(self._filled, np.uint32)])
        self._pool[begin : self._filled] = ids
        return begin, len(ids)

    def _other(self, text: str) -> tuple[int, int]:
        """Place and number of the ids of a text that is no piece of the table."""
        found = self._others.get(text)
        if found is None:
            found = self._store(self._ids(text))
            if len(text) < 64 and len(self._others) < _CACHE_OTHERS:
                self._others[text] = found
        return found

    def _find(self, keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Entry of each key, 0 if there is none."""
        entries = np.zeros(len(slots), np.int32)
        open_ = np.arange(len(slots))
        for _ in range(_PROBES):
            held = self._table[slots[open_]]
            same = held > 0
            for k in range(3):
                same &= self._keys[k][held] == keys[k][open_]
            entries[open_[same]] = held[same]
            open_ = open_[(held > 0) & ~same]
            slots[open_] = (slots[open_] + 1) & (self._slots - 1)
            if not len(open_):
                break
        return entries

    def _learn(self, keys: np.ndarray, slots: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and counts of pieces not met before; different ones are entered."""
        at: dict[str, int] = {}
        own = np.array([at.setdefault(p, len(at)) for p in pieces])
        ids: list[int] = []
        counts = []
        for piece in at:
            found = self._piece_ids(piece)
            ids += found
            counts.append(len(found))
        counts = np.array(counts, np.int64)
        offsets = self._store(ids)[0] + np.cumsum(counts) - counts
        first = np.full(len(at), -1)
        first[own[::-1]] = np.arange(len(pieces))[::-1]
        room = min(len(at), self._pieces - self._entries)
        new = np.arange(self._entries + 1, self._entries + 1 + room)
        self._entries += room
        self._keys[:, new] = keys[:, first[:room]]
        self._offsets[new], self._counts[new] = offsets[:room], counts[:room]
        places = slots[first[:room]]
        for _ in range(_PROBES):
            free = np.flatnonzero(self._table[places] == 0)
            self._table[places[free]] = new[free]
            left = self._table[places] != new  # what another one took in this round or before
            places, new = (places[left] + 1) & (self._slots - 1), new[left]
            if not len(new):
                break
        return offsets[own], counts[own]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id behind it; number of ids of each)."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self._entries >= self._pieces or self._filled > 16 * self._pieces:
            self._clear()
        plain = [not any(c in t and c + " " in t for c in _SPACES) for t in texts]
        raw = [t.encode() if p else b"" for t, p in zip(texts, plain)]
        data = np.frombuffer(b" ".join(raw) + b" " + bytes(24), np.uint8)
        ends = np.flatnonzero(data[:-24] == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
        heads = np.searchsorted(starts, begins[:-1])  # the piece at the front of each text
        # A mark behind plain letters is a token of its own.
        marks = data[ends - 1] * (ends - starts > 1)
        accented = np.zeros(len(data), bool)  # in UTF-8, byte C3 and one that makes a letter of it
        accented[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        strange = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~(_LETTERS[data] | accented | (data == 0xC3)), out=strange[1:])
        marked = ((marks == 46) | (marks == 44)) & (strange[np.maximum(ends - 1, starts)] == strange[starts])
        marked[heads] = False
        lengths = ends - marked - starts
        windows = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        keys = np.zeros((3, len(starts)), np.uint64)
        for k in range(3):
            kept = np.clip(lengths - 8 * k, 0, 8)
            keys[k] = windows[np.minimum(starts + 8 * k, len(windows) - 1)] & _KEPT[kept]
        keys[2] |= lengths.astype(np.uint64) << np.uint64(56)
        mixed = (keys[0] * _MIX[0]) ^ (keys[1] * _MIX[1]) ^ (keys[2] * _MIX[2])
        slots = ((mixed ^ (mixed >> np.uint64(29))) * _MIX[0] >> np.uint64(40)).astype(np.int64) & (self._slots - 1)
        ask = lengths < 24
        ask[heads] = False
        asked = np.flatnonzero(ask)
        own_keys = keys[:, asked]
        entries = self._find(own_keys, slots[asked])
        layout = np.zeros((2, len(starts), 3), np.int64)
        layout[0, asked, 0], layout[1, asked, 0] = self._offsets[entries], self._counts[entries]
        missed = np.flatnonzero(entries == 0)
        if len(missed):
            which = asked[missed]
            body = data.tobytes()
            pieces = [body[a : a + n].decode() for a, n in zip(starts[which], lengths[which])]
            layout[0, which, 0], layout[1, which, 0] = self._learn(own_keys[:, missed], slots[which], pieces)
        for i, at in enumerate(heads):
            if plain[i]:
                head = raw[i].partition(b" ")[0].decode()
                layout[:, at, 0] = self._other(head) if head else (0, 0)
            else:
                layout[:, at, 0] = self._store(self._whole(texts[i]))
        for at in np.flatnonzero(~ask):
            if not layout[1, at, 0] and lengths[at] >= 24:
                layout[:, at, 0] = self._other(" " + data[starts[at] : starts[at] + lengths[at]].tobytes().decode())
        for sign, place in self._marks.items():
            layout[:, marked & (marks == sign), 1] = np.array(place)[:, None]
        last = np.append(heads[1:], len(starts)) - 1
        layout[:, last, 2] = np.array(self._end)[:, None]
        offsets, counts = layout[0].ravel(), layout[1].ravel()
        before = np.cumsum(counts) - counts
        ids = self._pool[np.repeat(offsets - before, counts) + np.arange(counts.sum())]
        sizes = np.add.reduceat(layout[1].sum(axis=1), heads) if len(heads) else np.zeros(0, np.int64)
        return ids, sizes

    def _whole(self, text: str) -> list[int]:
        """Ids of a text in which blanks follow other white space, cut where that is safe."""
        found: list[int] = []
        for piece in _CUT.split(text):
            if piece:
                begin, count = self._other(piece)
                found += self._pool[begin : begin + count].tolist()
        return found


@lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(ends)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> str:
    """Encode ``docs`` (doc_id, text) into a new ``folder`` and return it.

    One shuffle deals the texts out by ranges of doc_id; the ids are written where they
    are made. A task that runs again writes the same file.
    """
    prepare(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = _encoder(tokenizer_path, end_id), TaskContext.get().partitionId(), 0
        for batch, texts in arrow_rows(batches, chars=1 << 18):
            ids, sizes = encoder.encode_all(texts)
            starts = before + np.concatenate([[0], np.cumsum(sizes)])
            before = int(starts[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(texts), part, np.int32)),
                    batch.column("doc_id"),
                    pa.array(starts[:-1]),
                    pa.array(sizes),
                    _lists(sizes, ids.astype(np.int32)),
                ],
                ["part", "doc_id", "offset", "n_tokens", "tokens"],
            )

    by = ["doc_id", F.xxhash64("text"), "text"]
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(*by[:2])
        .sortWithinPartitions(*by)
        .mapInArrow(encode, "part int, doc_id long, offset long, n_tokens long, tokens array<int>")
    )
    (
        rows.write.option("parquet.block.size", _ROW_GROUP_BYTES)
        .option("parquet.page.size", _PAGE_BYTES)
        .option("parquet.page.row.count.limit", _PAGE_ROWS)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .option("compression", "zstd")
        .parquet(f"{folder}/tokens")
    )
    spark = docs.sparkSession
    totals = (
        spark.read.schema("part int, doc_id long, n_tokens long")
        .parquet(f"{folder}/tokens")
        .groupBy("part")
        .agg(
            F.sum("n_tokens").alias("n_tokens"),
            F.count("*").alias("n_docs"),
            F.min("doc_id").alias("first_doc"),
            F.max("doc_id").alias("last_doc"),
        )
    )
    # One row for each file: the sort below holds no more than that.
    start = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")
    totals.withColumn("start", start).coalesce(1).write.parquet(f"{folder}/parts")
    return folder


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens of every document; no token is read."""
    return _placed(spark, folder, "")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, tokens; filters on doc_id skip files, row groups and pages."""
    return _placed(spark, folder, ", tokens array<int>")


def _placed(spark: SparkSession, folder: str, more: str) -> DataFrame:
    rows = spark.read.schema(f"part int, doc_id long, offset long, n_tokens long{more}").parquet(
        f"{folder}/tokens"
    )
    parts = spark.read.parquet(f"{folder}/parts").select("part", F.col("start").alias("base"))
    kept = [c for c in rows.columns if c not in ("part", "offset")]
    return rows.join(parts, "part").withColumn("start", F.col("base") + F.col("offset")).select(
        kept[0], "start", *kept[1:]
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
        ends = lists.offsets.to_numpy()
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("part"), batch.column("doc_id"), batch.column("offset"),
             batch.column("n_tokens"), pa.array(sums, pa.int64())],
            ["part", "doc_id", "offset", "n_tokens", "ids_crc32"],
        )


def checked(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    prepare(spark)
    rows = spark.read.schema(
        "part int, doc_id long, offset long, n_tokens long, tokens array<int>"
    ).parquet(f"{folder}/tokens")
    summed = rows.mapInArrow(
        _checksums, "part int, doc_id long, offset long, n_tokens long, ids_crc32 long"
    )
    parts = spark.read.parquet(f"{folder}/parts").select("part", F.col("start").alias("base"))
    return summed.join(parts, "part").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokenize(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and return what they hold, read back."""
    spark = docs.sparkSession
    return checked(spark, write_tokens(docs, tokenizer_path, folder or run_dir(spark, "token-files")))
