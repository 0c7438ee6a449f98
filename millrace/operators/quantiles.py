"""Exact order statistics of groups of any size, by narrowing histograms.

Spark's exact percentile holds a map of all values of a group in one task. Here every wanted
rank of a group starts with the range of the group's values. A pass counts the values in
equal parts of each range, which combine before the shuffle, and keeps the part that holds
the rank, down to its own least and greatest value. Once few enough values are left they are
sorted; a range of one value is done at once. So no more than `limit` values of a group meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import quoted, small, stash, unused

LIMIT, PARTS = 10_000, 1024
INF = float("inf")


def order_statistics(df: DataFrame, by: list[str], value: str | Column, ranks: dict[str, Callable[[Column], Column]], *, limit: int = LIMIT, parts: int = PARTS) -> DataFrame:
    """by's columns, n (values of the group) and for each name in ranks the value of that rank, from 0, as a double.

    ranks: from the column n to the rank, which must be from 0 to n - 1. Null and NaN values
    don't count, groups without others give no row; infinite ones do. A null key is a group.
    """
    keys = [f"g{i}" for i in range(len(by))]
    v = quoted(value) if isinstance(value, str) else value
    rows = df.select(*[quoted(b).alias(k) for b, k in zip(by, keys, strict=True)], v.cast("double").alias("v"))
    rows = stash(rows.where(F.col("v").isNotNull() & ~F.isnan("v")), "quantiles-values")
    finite = F.when(F.abs("v") < INF, F.col("v"))
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("v") == -INF).alias("below"), F.count_if(F.col("v") == INF).alias("above"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    asked = groups.select("*", F.posexplode(F.array(*[r(F.col("n")).cast("long") for r in ranks.values()])).alias("t", "k"))
    known = F.when(F.col("k") < F.col("below"), -INF).when(F.col("k") >= F.col("n") - F.col("above"), INF).when(F.col("low") == F.col("high"), F.col("low"))
    state = stash(asked.select(*keys, "n", "t", "low", "high", known.alias("found"), (F.col("k") - F.col("below")).alias("k"), (F.col("n") - F.col("below") - F.col("above")).alias("left")), "quantiles")

    def inside(wanted: DataFrame) -> DataFrame:
        """The values in each wanted range."""
        same = F.lit(True)
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"s{k}"))
        wanted = wanted.withColumnsRenamed({k: f"s{k}" for k in keys})
        return rows.join(wanted, same & F.col("v").between(F.col("low"), F.col("high"))).drop(*[f"s{k}" for k in keys])

    large = F.col("found").isNull() & (F.col("left") > limit)
    while state.where(large).count():
        wanted = small(stash(state.where(large).select(*keys, "n", "t", "low", "high", "k"), "quantiles-large"))
        wide = F.col("high") / 2 - F.col("low") / 2 > 1e307  # else a difference could be infinite
        share = F.when(wide, (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)).otherwise((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")))
        counts = inside(wanted).groupBy(*keys, "n", "t", "k", F.least(F.floor(share * parts), F.lit(parts - 1)).alias("part")).agg(F.count("*").alias("left"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("left").over(Window.partitionBy(*keys, "t").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))  # `parts` rows at most
        counts = counts.withColumn("upto", upto).where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("left") <= F.col("k")))
        counts = counts.select(*keys, "n", "t", "low", "high", F.when(F.col("low") == F.col("high"), F.col("low")).alias("found"), (F.col("k") - F.col("upto") + F.col("left")).alias("k"), "left")
        state = stash(state.where(~large).unionByName(counts), "quantiles")

    few = small(stash(state.where("found IS NULL").select(*keys, "t", "low", "high", "k"), "quantiles-few"))
    last = inside(few).groupBy(*keys, "t", "k").agg(F.sort_array(F.collect_list("v")).alias("all"))  # `limit` values at most
    last = last.select(*keys, "t", F.get("all", F.col("k").cast("int")).alias("last"))
    same = F.col("t") == F.col("st")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"s{k}"))
    found = state.join(last.withColumnsRenamed({c: f"s{c}" for c in (*keys, "t")}), same, "left").withColumn("found", F.coalesce("found", "last"))
    found = found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("t") == i, F.col("found"))).alias(name) for i, name in enumerate(ranks)])
    return found.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], "n", *ranks)


def group_quantiles(df: DataFrame, by: list[str], value: str | Column, wanted: dict[str, float], *, discrete: tuple[str, ...] = (), limit: int = LIMIT) -> DataFrame:
    """by's columns, n and exact quantiles: between the two nearest values, or for names in discrete the first value that so large a share doesn't exceed."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for i, (name, p) in enumerate(wanted.items()):
        if name in discrete:
            ranks[f"a{i}"] = lambda n, p=p: F.greatest(F.ceil(n * p) - 1, F.lit(0))
        else:
            ranks[f"a{i}"] = lambda n, p=p: F.floor((n - 1) * p)
            ranks[f"b{i}"] = lambda n, p=p: F.ceil((n - 1) * p)
    found = order_statistics(df, by, value, ranks, limit=limit)
    out = []
    for i, (name, p) in enumerate(wanted.items()):
        a = F.col(f"a{i}")
        if name not in discrete:
            b, part = F.col(f"b{i}"), (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
            a = F.when(a == b, a).otherwise(a * (1 - part) + b * part)
        out.append(a.alias(name))
    return found.select(*[quoted(b) for b in by], "n", *out)


def trimmed_means(df: DataFrame, by: list[str], value: str | Column, *, tenths: int = 1, limit: int = LIMIT) -> DataFrame:
    """by's columns, n and mean: of each group without its lowest and highest values, n * tenths // 10 of each."""
    cut = lambda n: F.floor(n * tenths / 10)
    ends = order_statistics(df, by, value, {"first": cut, "last": lambda n: n - 1 - cut(n)}, limit=limit)
    v = quoted(value) if isinstance(value, str) else value
    keys = [unused(f"k{i}", df) for i in range(len(by))]
    ends = small(stash(ends.withColumnsRenamed(dict(zip(by, keys, strict=True))), "trimmed-ends"))
    same = F.lit(True)
    for b, k in zip(by, keys, strict=True):
        same &= quoted(b).eqNullSafe(F.col(k))
    rows = df.select(*[quoted(b) for b in by], v.cast("double").alias(unused("v", df)))
    v = F.col(rows.columns[-1])
    rows = rows.where(v.isNotNull() & ~F.isnan(v)).join(ends, same)
    sums = rows.groupBy(*keys, "n", "first", "last").agg(
        F.sum(F.when((v > F.col("first")) & (v < F.col("last")), v).otherwise(0.0)).alias("between"), F.count_if(v <= F.col("first")).alias("low"), F.count_if(v >= F.col("last")).alias("high")
    )
    n, first, last, off = F.col("n"), F.col("first"), F.col("last"), cut(F.col("n"))
    mean = F.when(first == last, first).otherwise((F.col("between") + first * (F.col("low") - off) + last * (F.col("high") - off)) / (n - 2 * off))
    return sums.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], "n", mean.alias("mean"))
