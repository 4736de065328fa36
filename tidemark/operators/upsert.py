"""Keyed upsert between two frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    key: str,
    columns: Sequence[str],
    stamp: tuple[str, Column] | None = None,
) -> DataFrame:
    """``existing`` with the rows of ``incoming`` inserted or updated by ``key``.

    A matched row takes every non-key value of the incoming row, also its NULLs; an
    existing row without a match stays as it is. ``stamp`` names a column set on
    inserted and updated rows. ``key`` must be unique on each side.
    """
    old, new = existing.alias("old"), incoming.alias("new")
    arrived = F.col(f"new.{key}").isNotNull()
    merged = [F.coalesce(F.col(f"new.{key}"), F.col(f"old.{key}")).alias(key)]
    for name in columns:
        merged.append(
            F.when(arrived, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)
        )
    if stamp is not None:
        name, value = stamp
        merged.append(F.when(arrived, value).otherwise(F.col(f"old.{name}")).alias(name))
    return old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer").select(*merged)
