"""Functions in Python for what column functions can't say: an aggregate, a scalar function and table functions, over rows and over tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def geometric_mean(column: Column) -> Column:
    """As an aggregate of columns: it combines before the shuffle, which a Python aggregate can't."""
    return F.exp(F.avg(F.ln(F.when(column > 0, column))))


@pandas_udf(T.DoubleType())
def trimmed_mean(v: pd.Series) -> float:
    """Mean without the lowest and highest tenth: an aggregate in Python, which needs a group's values at once."""
    x = np.sort(v.dropna().to_numpy(dtype=float))
    cut = len(x) // 10
    return float(x[cut : len(x) - cut].mean()) if len(x) else float("nan")


@F.arrow_udf(T.LongType())
def digit_sum(v: pa.Array) -> pa.Array:
    """Sum of the decimal digits of each whole number, a batch at a time; null for null."""
    left = v.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    left = np.where(left < 0, (~left).astype(np.uint64) + np.uint64(1), left.astype(np.uint64))  # the least number has no positive one
    out = np.zeros(len(v), np.int64)
    while left.any():
        out, left = out + (left % np.uint64(10)).astype(np.int64), left // np.uint64(10)
    return pa.array(out, pa.int64(), mask=v.is_null().to_numpy(zero_copy_only=False))


@udtf(returnType=T.StructType([T.StructField("place", T.IntegerType()), T.StructField("word", T.StringType())]))
class Words:
    """The words of a text with their places from 0; no rows for null."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(text.split())


@udtf
class Runs:
    """Rows of a table whose kinds follow a pattern one right after another: of each match its key, first and last value, and number of rows.

    eval's arguments: a table, PARTITION BY its first column and ORDER BY the third, with the
    kinds in the second; and the pattern, kinds apart by spaces, each with a plus if it may
    repeat. The result's columns follow the table's: the key's and the order's names and types.
    Matches don't overlap, and of those that end at a row the one that began first counts. A
    row with a null kind matches nothing. What is held between rows is one start for each
    kind of the pattern, however many rows a key has.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) != 3:
            raise ValueError("a table of key, kind and order is needed")
        if pattern.value is None or not pattern.value.split():
            raise ValueError("the pattern must name kinds, apart by spaces")
        key, kind, order = rows.dataType.fields
        return AnalyzeResult(T.StructType([T.StructField(key.name, key.dataType), T.StructField("began", order.dataType), T.StructField("ended", order.dataType), T.StructField("n", T.LongType())]), partitionBy=[PartitioningColumn(key.name)], orderBy=[OrderingColumn(order.name)])

    def __init__(self):
        self.steps: list[tuple[str, bool]] = []
        self.at: list[tuple] = []  # number of the first row, its value, rows so far; by steps done

    def eval(self, rows, pattern: str) -> Iterator[tuple]:
        if not self.steps:
            self.steps = [(p.rstrip("+"), p.endswith("+")) for p in pattern.split()]
            self.at, self.row = [None] * (len(self.steps) + 1), 0
        key, kind, value = rows[0], rows[1], rows[2]
        self.row += 1
        now = [None] * len(self.at)
        for done, (name, repeats) in enumerate(self.steps):
            if kind != name:
                continue
            came = [x for x in ((self.at[done] if done else (self.row, value, 0)), self.at[done + 1] if repeats else None) if x]
            if came:
                first = min(came)
                now[done + 1] = (first[0], first[1], first[2] + 1)
        if now[-1]:
            yield key, now[-1][1], value, now[-1][2]
            now = [None] * len(self.at)
        self.at = now
