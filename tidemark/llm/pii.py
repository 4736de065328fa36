"""Personal data: patterns propose spans, checksums confirm, context words decide.

Four base kinds (email, ip, card, phone) are fixed by pattern and check alone and always
count. More kinds are proposed by looser patterns and scored: a prior for the kind, plus
what a confirmed checksum adds (a failed one ends it), plus what a context word within
``NEAR`` characters adds. Spans from ``LEAST`` on are reported, unless they overlap a base
span or a better one.

==========  =====================================  =======================
kind        proposed by                            confirmed by
==========  =====================================  =======================
iban        country, two digits, 11-30 more signs  mod-97
account     12 or 13 digits                        Luhn, and context
ssn         3-2-4 digits                           number ranges, context
local       3-3-4 digits without a country code    context
passport    1-2 capitals and 6-8 digits            context
==========  =====================================  =======================

Places are code points, ends exclusive. Null and empty texts have no spans. Every pattern
runs in time linear in the text, long runs of one sign included. Rows are independent:
no shuffle, repeated rows get equal answers, extra columns are not read, an empty table
gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "account", "ssn", "local", "passport")
_ORDER = {kind: i for i, kind in enumerate(BASE_KINDS + MORE_KINDS)}

#: Scores: prior of a kind, what a passed checksum and a context word add, and the least.
PRIOR = {"iban": 0.3, "account": 0.1, "ssn": 0.25, "local": 0.2, "passport": 0.2}
CONFIRMED = {"iban": 0.6, "account": 0.3, "ssn": 0.1, "local": 0.0, "passport": 0.0}
CONTEXT = 0.4
LEAST = 0.6
NEAR = 40
#: Words that make a kind likelier, in lower case.
CONTEXT_WORDS = {
    "iban": ("iban", "bank", "konto", "cuenta", "compte", "account"),
    "account": ("account", "card", "konto", "karte", "cuenta", "tarjeta", "compte", "carte"),
    "ssn": ("ssn", "social security", "taxpayer", "tax id"),
    "local": ("phone", "call", "tel", "fax", "mobile", "telefon", "teléfono", "téléphone"),
    "passport": ("passport", "reisepass", "pasaporte", "passeport"),
}

_LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive, and begun at the first digit of a run only: a later start of the same run
# fails as the first did, so the matches are those of the plain pattern.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_PLAIN = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_PASSPORT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Whether an account number without blanks leaves 1 after the letters are numbered."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(sign, 36)) for sign in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches, found from each @ outwards."""
    floor, at = 0, text.find("@")
    while at >= 0:
        head = text[floor:at]
        start = at - (len(head) - len(head.rstrip(_LOCAL_PART)))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[Span]:
    found = [Span("email", a, b, 1.0) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(Span("ip", m.start(), m.end(), 1.0))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(Span("card", m.start(), m.end(), 1.0))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append(Span("phone", m.start(), m.end(), 1.0))
    return found


def _proposals(text: str) -> Iterator[tuple[str, int, int, bool | None]]:
    """(kind, start, end, checksum passed); a failed checksum is not proposed at all."""
    for m in _IBAN.finditer(text):
        # The run may go on into words behind the number: the longest part that checks.
        ends = [i for i in range(len(m[0]), 14, -1) if m[0][i : i + 1] in ("", " ") and m[0][i - 1] != " "]
        for end in ends:
            if mod97(m[0][:end].replace(" ", "")):
                yield "iban", m.start(), m.start() + end, True
                break
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 25:
            digits = _digits(m[0])
            if len(digits) in (12, 13) and luhn(digits):
                yield "account", m.start(), m.end(), True
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", m.start(), m.end(), True
    for m in _PLAIN.finditer(text):
        yield "local", m.start(), m.end(), None
    for m in _PASSPORT.finditer(text):
        yield "passport", m.start(), m.end(), None


def more_spans(text: str, base: list[Span]) -> list[Span]:
    scored = []
    for kind, start, end, passed in _proposals(text):
        around = text[max(0, start - NEAR) : end + NEAR].lower()
        score = PRIOR[kind] + (CONFIRMED[kind] if passed else 0)
        score += CONTEXT if any(w in around for w in CONTEXT_WORDS[kind]) else 0
        if score >= LEAST - 1e-9:
            scored.append(Span(kind, start, end, round(min(score, 1.0), 2)))
    # Sorted by place, a span can only overlap its neighbours: sweep once over both lists.
    taken: list[Span] = []
    for span in sorted(scored, key=lambda s: (s.start, -s.score, _ORDER[s.kind])):
        if taken and span.start < taken[-1].end:
            if span.score > taken[-1].score:
                taken[-1] = span
            continue
        taken.append(span)
    blocked = sorted((s.start, s.end) for s in base)
    free, i, reach = [], 0, -1
    for span in taken:
        while i < len(blocked) and blocked[i][0] < span.end:
            reach = max(reach, blocked[i][1])
            i += 1
        if reach <= span.start:
            free.append(span)
    return free


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, _ORDER[s.kind]))


_SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "spans string, found array<struct<kind:string,start:int,end:int,score:double>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    )
    for batch in batches:
        counts = {k: [] for k in BASE_KINDS}
        digests, joined, found = [], [], []
        for text in batch.column("text").to_pylist():
            base = in_order(base_spans(text or ""))
            spans = in_order(base + more_spans(text or "", base))
            for k in BASE_KINDS:
                counts[k].append(sum(s.kind == k for s in base))
            digests.append(hashlib.sha256(",".join(map(str, base)).encode()).hexdigest())
            joined.append(",".join(map(str, spans)))
            found.append([s._asdict() for s in spans])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS),
                pa.array(digests),
                pa.array(joined),
                pa.array(found, kind),
            ],
            ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "found"],
        )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, digest, joined spans, and spans with scores."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, _SCHEMA)
