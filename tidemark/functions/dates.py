"""Yearly-recurrence countdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_DATE_DAYS = 365
YEAR_DAYS = 365


def days_to_recurrence(day: Column, ref: Column, leap: str = "today") -> Column:
    """Days from ``ref`` to the yearly recurrence of ``day``, 0..364; 365 without a date.

    The recurrence is looked up in the calendar year of ``ref`` and folded modulo 365, so
    leap days are not counted. A Feb 29 in a common year counts as ``ref`` itself (0 days)
    by default; ``leap="feb28"`` moves it to Feb 28 instead.
    """
    if leap not in ("today", "feb28"):
        raise ValueError(f"unknown leap rule: {leap}")
    moved = F.add_months(day, (F.year(ref) - F.year(day)) * 12)
    if leap == "today":
        moved = F.when(F.dayofmonth(moved) == F.dayofmonth(day), moved).otherwise(ref)
    return F.when(day.isNull(), F.lit(NO_DATE_DAYS)).otherwise(
        F.pmod(F.datediff(moved, ref), F.lit(YEAR_DAYS))
    )
