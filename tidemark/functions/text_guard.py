"""Personal-data and keyword checks on text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Banned keywords.
BANNED_KEYWORDS = ["password", "credit card number", "aadhaar"]

# Only ASCII classes, so every regex engine agrees. One character before the @ is enough to
# find an address, and keeps the scan linear. A number may not touch a further digit; the
# digit in front is tested after the first group, so other characters fail at once. A
# national id is not part of a longer row of digit groups, such as a card number.
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z][A-Za-z]"
CARD_PATTERN = r"[0-9]{4}(?<![0-9]{5})[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9])"
NATIONAL_ID_PATTERN = (
    r"[0-9]{4}(?<![0-9]{5})(?<![0-9][ -][0-9]{4}) [0-9]{4} [0-9]{4}(?![ -]?[0-9])"
)
TWELVE_DIGITS = r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"


def guard_reasons(text: Column, keywords: Sequence[str] = BANNED_KEYWORDS) -> Column:
    """Reasons to block the whole text, joined by ``'; '``; empty when it may pass.

    A cheaper necessary condition runs before each pattern: an ``@`` for addresses, and
    twelve digits, looked for once, for both kinds of number.
    """
    at_sign = F.contains(text, F.lit("@"))
    digits = F.regexp_like(text, F.lit(TWELVE_DIGITS))
    checks = {
        "email": at_sign & F.regexp_like(text, F.lit(EMAIL_PATTERN)),
        "card_number": digits & F.regexp_like(text, F.lit(CARD_PATTERN)),
        "national_id": digits & F.regexp_like(text, F.lit(NATIONAL_ID_PATTERN)),
    }
    for word in keywords:
        checks[f"keyword:{word}"] = F.contains(F.lower(text), F.lit(word.lower()))
    return F.concat_ws("; ", *[F.when(hit, F.lit(name)) for name, hit in checks.items()])
