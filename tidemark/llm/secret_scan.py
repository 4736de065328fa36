"""Secrets: fixed patterns, and random strings told by how badly a vocabulary fits them.

Three base kinds (assign, access, hex) are fixed by pattern alone and always count. The
kind ``random`` is found by a token-efficiency test: a public byte-pair vocabulary cuts
words of any language it knows into few long pieces, but random strings into many short
ones. A run of ``LONG`` or more key characters, holding letters, is reported when it has
fewer than ``RATIO`` characters per token; else the parts of it, from sign to sign, around
stretches of ``LONG`` characters that have, so that words before a secret don't hide it.
Known digests (hex runs of the usual digest
lengths), UUIDs, and identifiers (alphabetic parts joined by signs, with a number at the
end at most) are excluded; an identifier only if its letter parts have ``RATIO`` characters
per token or more. Spans that overlap a base span are left out.

Places are code points, ends exclusive; an ``assign`` span is the whole assignment. Null
and empty texts have no spans, an empty table gives no row. Every pattern runs in time linear in the text. Rows are
independent: no shuffle, repeated rows get equal answers, extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare

BASE_KINDS = ("assign", "access", "hex")
_ORDER = {kind: i for i, kind in enumerate((*BASE_KINDS, "random"))}
#: Shortest run tested, signs of the stretches of a longer one, and characters per token
#: below which either counts as random.
LONG = 20
RATIO = 2.0
#: Hex digits of the common digests.
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)

# (?a) keeps signs such as the Kelvin sign from passing as k when case is ignored.
_ASSIGN = re.compile(
    r"""(?a)((?i:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
)
_ASSIGN_GATES = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}+")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LONG},}}+")
_PART = re.compile(r"[A-Za-z0-9]+")
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_IDENTIFIER = re.compile(r"(?:[A-Za-z]+[+/_=-]+)*[A-Za-z]*[+/_=-]*[0-9]{0,6}")

_LETTERS = re.compile(r"[A-Za-z]+")


@lru_cache(maxsize=2)
def _vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _tokens(run: str, vocabulary: tiktoken.Encoding) -> int:
    # Pieces of bounded length: the vocabulary's time grows faster than a run.
    return sum(len(vocabulary.encode_ordinary(run[k : k + 512])) for k in range(0, len(run), 512))


def known(run: str, vocabulary: tiktoken.Encoding) -> bool:
    """Whether a run is a digest, a UUID or an identifier of words that the vocabulary fits."""
    if len(run) in DIGEST_LENGTHS and _DIGEST.fullmatch(run):
        return True
    if _UUID.fullmatch(run):
        return True
    if not _IDENTIFIER.fullmatch(run):
        return False
    parts = _LETTERS.findall(run)
    return sum(map(len, parts)) >= RATIO * sum(_tokens(p, vocabulary) for p in parts)


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the base kinds; ``runs`` are the text's long runs of key characters."""
    found = []
    lowered = text.lower()
    if any(gate in lowered for gate in _ASSIGN_GATES):
        found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    # 24 hex digits and 20 characters of an access key lie inside a long run.
    for start, end in runs:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text, start, end)
                  if m.end() - m.start() >= 20]
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text, start, end)]
    return found


def _random(run: str, vocabulary: tiktoken.Encoding) -> bool:
    return (
        any(c.isalpha() for c in run)
        and len(run) < RATIO * _tokens(run, vocabulary)
        and not known(run, vocabulary)
    )


def random_parts(run: str, vocabulary: tiktoken.Encoding) -> list[tuple[int, int]]:
    """Ranges of a run that look random: all of it, else parts around random stretches.

    Words before a secret raise the ratio of the whole run. So every stretch of ``LONG``
    characters is tested too, but for those that touch a digest or a UUID, and what is
    random grows to the nearest signs on both sides.
    """
    parts = [m.span() for m in _PART.finditer(run)]
    digests = [(a, b) for a, b in parts if b - a in DIGEST_LENGTHS and _DIGEST.fullmatch(run, a, b)]
    barred = bytearray(len(run))
    for a, b in [*digests, *(m.span() for m in _UUID.finditer(run))]:
        barred[a:b] = b"\1" * (b - a)
    if 1 not in barred and _random(run, vocabulary):
        return [(0, len(run))]
    if len(run) == LONG or not parts:
        return []
    # Numbers, and letters that the vocabulary fits, must not fill half of a stretch.
    plain = bytearray(len(run))
    for a, b in parts:
        part = run[a:b]
        if part.isdigit() or part.isalpha() and len(part) >= RATIO * _tokens(part, vocabulary):
            plain[a:b] = b"\1" * (b - a)
    starts, ends = zip(*parts)
    found: list[tuple[int, int]] = []
    for start in range(len(run) - LONG + 1):
        end = start + LONG
        if found and end <= found[-1][1] or 1 in barred[start:end] or 2 * plain[start:end].count(1) >= LONG:
            continue
        if not _random(run[start:end], vocabulary):
            continue
        low, high = starts[bisect_right(ends, start)], ends[bisect_left(starts, end) - 1]
        if found and low <= found[-1][1]:
            low = found.pop()[0]
        found.append((low, high))
    return found


def random_spans(
    text: str, runs: list[tuple[int, int]], base: list[tuple[str, int, int]], vocabulary: tiktoken.Encoding
) -> list[tuple[str, int, int]]:
    """Spans in runs that no base span touches."""
    blocked = sorted((a, b) for _, a, b in base)
    found, i, reach = [], 0, -1
    for start, end in runs:
        while i < len(blocked) and blocked[i][0] < end:
            reach = max(reach, blocked[i][1])
            i += 1
        if reach <= start:
            found += [("random", start + a, start + b) for a, b in random_parts(text[start:end], vocabulary)]
    return found


def find_secrets(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """Per document: counts of the base kinds, digest of their spans, all spans joined.

    ``vocabulary_path`` is a tiktoken rank file that every executor has, ``pattern`` the
    one that splits text before the merges.
    """
    prepare(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(vocabulary_path, pattern)
        for batch in batches:
            counts = {k: [] for k in BASE_KINDS}
            digests, joined = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                runs = [m.span() for m in _RUN.finditer(text)]
                order = lambda s: (s[1], _ORDER[s[0]])
                base = sorted(base_spans(text, runs), key=order)
                spans = sorted(base + random_spans(text, runs, base, vocabulary), key=order)
                for k in BASE_KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                write = lambda part: ",".join(f"{k}:{a}:{b}" for k, a, b in part)
                digests.append(hashlib.sha256(write(base).encode()).hexdigest())
                joined.append(write(spans))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS),
                    pa.array(digests),
                    pa.array(joined),
                ],
                ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scan,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )
