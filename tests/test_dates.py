from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions.dates import days_to_recurrence

COMMON, LEAP = date(2001, 8, 1), date(2024, 1, 1)


def days(spark, day, ref, leap="today"):
    df = spark.createDataFrame([(day, ref)], "day date, ref date")
    return df.select(days_to_recurrence(F.col("day"), F.col("ref"), leap)).first()[0]


@pytest.mark.parametrize(
    "day, ref, expected",
    [
        (None, COMMON, 365),
        (date(1990, 8, 1), COMMON, 0),
        (date(1990, 8, 31), COMMON, 30),
        (date(1990, 7, 31), COMMON, 364),
        (date(1990, 1, 1), COMMON, 153),
        (date(1990, 12, 31), COMMON, 152),
        (date(1988, 2, 29), COMMON, 0),
        (date(1988, 2, 29), LEAP, 59),
        # 365 days ahead inside a leap year folds to 0.
        (date(1990, 12, 31), LEAP, 0),
        # Past, with the next recurrence beyond a leap day: one day short.
        (date(1990, 1, 1), date(2023, 12, 31), 1),
    ],
)
def test_recurrence(spark, day, ref, expected):
    assert days(spark, day, ref) == expected


def test_leap_day_moved_to_feb_28(spark):
    assert days(spark, date(1988, 2, 29), date(2001, 2, 1), "feb28") == 27
    assert days(spark, date(1988, 2, 29), LEAP, "feb28") == 59
    with pytest.raises(ValueError):
        days(spark, COMMON, COMMON, "other")


def test_matches_calendar_arithmetic(spark):
    """All days of two years against plain date arithmetic."""
    refs = [date(2001, 8, 1), date(2004, 2, 29), date(2000, 12, 31)]
    rows = [(date.fromordinal(o), ref) for ref in refs for o in range(date(1999, 1, 1).toordinal(), date(2001, 1, 1).toordinal())]
    df = spark.createDataFrame(rows, "day date, ref date")
    got = df.select("day", "ref", days_to_recurrence(F.col("day"), F.col("ref")).alias("d")).collect()

    def expected(day, ref):
        try:
            moved = day.replace(year=ref.year)
        except ValueError:
            moved = ref
        return (moved - ref).days % 365

    assert all(row.d == expected(row.day, row.ref) for row in got)
