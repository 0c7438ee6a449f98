"""Samples by hashed keys: the same rows in every run, on any partitioning and in any engine with MD5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import quoted, unused


def place(keys: list[str], seed: int) -> Column:
    """A number from 0 to 2^32 - 1 by MD5 of the seed and the keys as text, joined by colons; a null counts as an empty text."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(quoted(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def keys_sampled(df: DataFrame, keys: list[str], fraction: float, *, seed: int = 0) -> DataFrame:
    """All rows of about that fraction of the keys' values, without a shuffle; a larger fraction takes the same rows and more."""
    return df.where(place(keys, seed) < F.lit(int(fraction * 2**32)))


def rows_of_each(df: DataFrame, groups: list[str], ids: list[str], n: int, *, seed: int = 0) -> DataFrame:
    """n rows of each group, or all if fewer, by the smallest places of their ids; ties by the ids, null first.

    Every task keeps n rows a group before the shuffle, so a group of any size costs n rows a task.
    """
    where, rank = unused("place", df), unused("rank", df)
    first = Window.partitionBy(*[quoted(g) for g in groups]).orderBy(where, *[quoted(i).asc_nulls_first() for i in ids])
    return df.withColumn(where, place(ids, seed)).withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= n).drop(where, rank)
