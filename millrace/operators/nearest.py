"""The nearest row of another table in time, before or after, by a cogrouped map over salted keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import quoted

#: A bucket's length in units of the distance; rows of a group that is searched in one call.
SALT, GROUP_ROWS = 4, 50_000


def nearest_join(left: DataFrame, right: DataFrame, *, on: str, left_time: str, right_time: str, left_id: str, right_id: str, within_seconds: int) -> DataFrame:
    """left_id, right_id and apart (microseconds, negative if the right row came before) of each left row that has a right row of its key at most within_seconds away.

    Of right rows equally near the earlier one counts, then the smaller id. Keys are salted by
    buckets of time SALT times as long as within_seconds: a left row is in its own bucket, a
    right row in its own and in one beside it if it is near that, so a key with many rows is
    spread over many tasks and each left row meets all that can be near it in one of them.
    Buckets are put together into groups of about GROUP_ROWS rows (rows are counted first), as
    each group is a call; in it, the right side is sorted once, by bucket and time, and
    searched for all left rows. Rows with a null key, time or id take no part; ids are whole
    numbers and times of one kind, with or without zone. Repeated rows have results each.
    """
    wide = within_seconds * 1_000_000

    def micros(df: DataFrame, name: str):
        c = quoted(name)
        return F.unix_micros(c) if df.schema[name].dataType.typeName() == "timestamp" else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)

    a = left.select(quoted(on).alias("k"), micros(left, left_time).alias("t"), quoted(left_id).cast("long").alias("i")).dropna()
    b = right.select(quoted(on).alias("k2"), micros(right, right_time).alias("t2"), quoted(right_id).cast("long").alias("j")).dropna()
    bucket = lambda t: F.floor(t / (SALT * wide))
    groups = max(1, -(-(a.count() + b.count()) // GROUP_ROWS))
    grouped = lambda df, k, salt: df.withColumn("g", F.pmod(F.xxhash64(k, salt), F.lit(groups)))
    a = grouped(a.withColumn("salt", bucket(F.col("t"))), "k", "salt")
    b = b.withColumn("salt2", F.explode(F.sequence(bucket(F.col("t2") - wide), bucket(F.col("t2") + wide))))
    b = grouped(b, "k2", "salt2").withColumnRenamed("g", "g2")

    def places(one: pa.Table, two: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """A number for each row of both, equal for rows of one key and bucket."""
        out = np.zeros(len(one) + len(two), np.int64)
        for x, y in (("k", "k2"), ("salt", "salt2")):
            codes = pa.chunked_array([*one[x].chunks, *two[y].chunks], one[x].type).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            out = np.unique(out * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
        return out[: len(one)], out[len(one) :]

    def search(one: pa.Table, two: pa.Table) -> pa.Table:
        t, i = one["t"].to_numpy(), one["i"].to_numpy()
        u, j = two["t2"].to_numpy(), two["j"].to_numpy()
        if not len(t) or not len(u):
            return pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "apart": pa.array([], pa.int64())})
        p, q = places(one, two)
        order = np.lexsort((j, u, q))
        u, j, q = u[order], j[order], q[order]
        first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (q[1:] != q[:-1])]))  # the smallest id at each place and time
        u, j, q = u[first], j[first], q[first]
        # a place and the rank of a time in one number, which orders as the two do
        times, ranks = np.unique(u, return_inverse=True)
        after = np.searchsorted(q * (len(times) + 1) + ranks, p * (len(times) + 1) + np.searchsorted(times, t))
        before, after = np.maximum(after - 1, 0), np.minimum(after, len(u) - 1)
        far = np.iinfo(np.int64).max
        left, right = (np.where(q[x] == p, np.abs(u[x] - t), far) for x in (before, after))
        best = np.where(left <= right, before, after)
        ok = np.minimum(left, right) <= wide
        return pa.table({"i": i[ok], "j": j[best][ok], "apart": (u[best] - t)[ok]})

    found = a.groupBy("g").cogroup(b.groupBy("g2")).applyInArrow(search, "i long, j long, apart long")
    return found.select(F.col("i").alias(left_id), F.col("j").alias(right_id), "apart")
