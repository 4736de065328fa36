"""Named dimensions and measures over a source, combined per question."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_mean(column: Column) -> Column:
    """Mean from the exact DECIMAL sum, so it does not depend on the order of addition."""
    return F.sum(column).cast("double") / F.count(column)


@dataclass(frozen=True)
class MetricView:
    """One definition of each KPI, shared by every query that reports it."""

    source: DataFrame
    dimensions: dict[str, Column]
    measures: dict[str, Column]

    def query(
        self,
        measures: Sequence[str],
        by: Sequence[str] = (),
        where: Column | None = None,
    ) -> DataFrame:
        """Measures grouped by dimensions (all rows form one group without any).

        ``where`` may use dimension names; it is applied before the aggregation, so
        Catalyst can push it to the scan.
        """
        unknown = [n for n in measures if n not in self.measures]
        unknown += [n for n in by if n not in self.dimensions]
        if unknown:
            raise KeyError(f"not defined in this view: {', '.join(unknown)}")
        rows = self.source.withColumns(
            {name: expr for name, expr in self.dimensions.items()}
        )
        if where is not None:
            rows = rows.where(where)
        wanted = [self.measures[name].alias(name) for name in measures]
        return rows.groupBy(*[F.col(name) for name in by]).agg(*wanted)
