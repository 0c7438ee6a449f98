"""Range join of two large sides on numbers, by a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import quoted, unused

#: Rows for each task of the join: its pairs can be many more than its rows, so tasks follow the rows and not their bytes.
TASK_ROWS = 20_000


def band_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, width: float, *, on: list[tuple[str, str]] | None = None, upward: bool = False) -> DataFrame:
    """Pairs whose numbers differ by at most width, and whose columns named in ``on`` are equal.

    Numbers fall into cells of that width; left rows enter their own cell and both beside it,
    right rows their own, so every pair meets exactly once and the join is an equi-join.
    upward: only pairs whose right number isn't below the left one, so left rows needn't enter
    the cell below. Null and non-finite numbers match nothing. The two sides' columns must
    have different names. Rows are counted first: they are dealt out by cell and ``on`` over
    a task for each TASK_ROWS, which Spark doesn't join into fewer however small they are.
    """
    own, others = unused("cell", left, right), unused("other_cell", left, right)
    cell = lambda c: F.floor(quoted(c) / width)
    finite = lambda df, c: df.where(quoted(c).isNotNull() & (F.abs(quoted(c).cast("double")) < float("inf")))  # noqa: E731  NaN is above infinity
    near = finite(left, left_col).withColumn(own, F.explode(F.sequence(cell(left_col) - (0 if upward else 1), cell(left_col) + 1)))
    other = finite(right, right_col).withColumn(others, cell(right_col))
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max(left.count(), right.count()) // TASK_ROWS))
    near = near.repartition(tasks, F.col(own), *[quoted(a) for a, _ in on or []])
    other = other.repartition(tasks, F.col(others), *[quoted(b) for _, b in on or []])
    apart = quoted(right_col) - quoted(left_col)
    meet = (F.col(own) == F.col(others)) & (apart.between(0, width) if upward else F.abs(apart) <= width)
    for a, b in on or []:
        meet &= quoted(a) == quoted(b)
    return near.join(other, meet).drop(own, others)
