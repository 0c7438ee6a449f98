"""Statistical aggregates by estimators that Spark's own functions don't offer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _spread(n: Column, kind: int) -> Column:
    return F.when(n > kind, n)


def sample_skewness(column: str | Column) -> Column:
    """Skewness corrected for the sample's size; null for fewer than three values. Spark's own is the population's."""
    c = F.col(column) if isinstance(column, str) else column
    n = _spread(F.count(c), 2)
    return F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(c)


def sample_kurtosis(column: str | Column) -> Column:
    """Excess kurtosis corrected for the sample's size; null for fewer than four values. Spark's own is the population's."""
    c = F.col(column) if isinstance(column, str) else column
    n = _spread(F.count(c), 3)
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
