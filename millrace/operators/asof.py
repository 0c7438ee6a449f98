"""As-of join: each left row with the latest right row of the same keys at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import quoted


def asof_join(left: DataFrame, right: DataFrame, *, on: list[str], left_time: str, right_time: str, bucket: str = "1 day") -> DataFrame:
    """left's rows, all of them, with right's other columns; nulls where no right row came before.

    Both sides meet in one union, sorted by time within (keys, bucket of time), so a key with
    many rows is split by its buckets. The last right row of each bucket, at most one per key
    and bucket, is carried to later buckets and used where a row's own bucket has none before it.
    A right row at the same time as a left one counts as before it. Rows with null keys or
    times match nothing; of right rows at one time, the greatest by its other columns counts.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    carried = [c for c in right.columns if c not in on]
    cut = lambda c: F.window(quoted(c), bucket)["start"]
    whole = F.struct(*[quoted(c) for c in left.columns])
    match = F.struct(*[quoted(c) for c in carried])
    held = F.lit(True)
    for c in [*on, left_time]:
        held = held & quoted(c).isNotNull()
    l_rows = left.where(held).select(*[quoted(k).alias(n) for k, n in zip(on, keys, strict=True)], quoted(left_time).alias("_time"), cut(left_time).alias("_cut"), F.lit(1).alias("_side"), whole.alias("_left"))
    r_rows = right.select(*[quoted(k).alias(n) for k, n in zip(on, keys, strict=True)], quoted(right_time).alias("_time"), cut(right_time).alias("_cut"), F.lit(0).alias("_side"), match.alias("_right"))
    for k in [*keys, "_time"]:
        r_rows = r_rows.where(F.col(k).isNotNull())
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_cut").orderBy("_time", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_found", F.last("_right", ignorenulls=True).over(within)).where("_side = 1")
    # one row per key and bucket: the last right row of all earlier buckets that have left or right rows
    cuts = both.groupBy(*keys, "_cut").agg(F.max(F.when(F.col("_side") == 0, F.struct("_time", "_right"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select(*keys, "_cut", F.last("_last", ignorenulls=True).over(before)["_right"].alias("_carried"))
    found = near.join(cuts, [*keys, "_cut"]).select("_left", F.coalesce("_found", "_carried").alias("_right"))
    rest = left.where(~held).select(whole.alias("_left"), F.lit(None).cast(found.schema["_right"].dataType).alias("_right"))
    return found.unionByName(rest).select("_left.*", "_right.*")
