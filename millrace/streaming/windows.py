"""Event-time operators for Structured Streaming; each takes a streaming or a batch DataFrame.

Watermarks need a TIMESTAMP column, so event_time casts one without zone first (in the
session's time zone). State is kept in the key's partition and dropped as the watermark passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import unused


def event_time(df: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """df with ts as TIMESTAMP and a watermark that waits for rows as late as that."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed(df: DataFrame, keys: list[str], aggregates: list[Column], *, ts: str = "ts", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling windows, or sliding ones with slide: keys, began, ended and the aggregates."""
    cut = F.window(ts, size, slide) if slide else F.window(ts, size)
    found = df.groupBy(*keys, cut.alias("window")).agg(*aggregates)
    return found.select(*keys, F.col("window.start").alias("began"), F.col("window.end").alias("ended"), *found.columns[len(keys) + 1 :])


def sessions(df: DataFrame, keys: list[str], aggregates: list[Column], *, ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Session windows that close after a gap: keys, began, ended and the aggregates."""
    found = df.groupBy(*keys, F.session_window(ts, gap).alias("window")).agg(*aggregates)
    return found.select(*keys, F.col("window.start").alias("began"), F.col("window.end").alias("ended"), *found.columns[len(keys) + 1 :])


def first_seen(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per keys: on a stream within the watermark's delay, which bounds the state; in a batch over all rows."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def paired(left: DataFrame, right: DataFrame, keys: list[str], *, left_ts: str, right_ts: str, within: str, how: str = "inner") -> DataFrame:
    """Interval join: right rows of the same keys at most that long after the left one. Watermarks on both sides bound the state.

    how: inner; or left, which gives a left row without a match as well, with nulls, once the
    watermarks have passed all that could match it.
    """
    other = {k: unused(f"other_{k}", left, right) for k in keys}
    r = right.withColumnsRenamed(other)
    same = F.col(right_ts).between(F.col(left_ts), F.col(left_ts) + F.expr(f"INTERVAL {within}"))
    for k in keys:
        same = same & (F.col(k) == F.col(other[k]))
    return left.join(r, same, how).drop(*other.values())
