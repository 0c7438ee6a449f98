"""Running values against windows, for keys of any share of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators.scan import Lag, Running, scan


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    return spark.createDataFrame([(r.choice(["a", "a", "a", "b", None, "c"]), i if i % 17 else None, r.choice([None, 1, 2, -3, 5])) for i in range(3000)], "`k.k` string, o long, part int").where("o IS NOT NULL")


@pytest.mark.parametrize("falling", [False, True])
def test_scan_gives_what_windows_give(rows, falling):
    order = F.col("o").desc() if falling else F.col("o")
    got = scan(rows, ["k.k"], [order], {"s": Running("sum", "part"), "n": Running("count", "part"), "low": Running("min", "part"), "high": Running("max", "part"), "before": Lag("part"), "third": Lag("part", 3)})
    w = Window.partitionBy("`k.k`").orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("*", F.sum("part").over(upto), F.count("part").over(upto), F.min("part").over(upto), F.max("part").over(upto), F.lag("part").over(w), F.lag("part", 3).over(w))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert got.columns == [*rows.columns, "s", "n", "low", "high", "before", "third"]


def test_lags_reach_over_small_parts(spark):
    df = spark.range(40).select(F.lit(1).alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    got = scan(df, ["k"], ["o"], {"before": Lag("v", 7)}, parts=20).orderBy("o").collect()
    assert [r["before"] for r in got] == [None if i < 7 or (i - 7) % 5 == 0 else i - 7 for i in range(40)]


def test_scan_of_all_rows_and_of_none(spark, rows):
    got = [r["n"] for r in scan(rows, [], ["o"], {"n": Running("count", F.lit(1))}).orderBy("o").collect()]
    assert got == list(range(1, len(got) + 1))
    assert scan(rows.where("false"), ["k.k"], ["o"], {"n": Running("count", F.lit(1))}).count() == 0
    same = spark.createDataFrame([(1, 1)] * 500, "k int, o int")  # nothing tells these rows apart
    assert sorted(r["n"] for r in scan(same, ["k"], ["o"], {"n": Running("count", F.lit(1))}).collect()) == list(range(1, 501))


def test_one_key_is_spread_over_parts(spark, monkeypatch):
    from millrace.operators import scan as module

    stored = []
    monkeypatch.setattr(module, "stash", lambda df, name, put=module.stash: stored.append(put(df, name)) or stored[-1])
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    seen = scan(df, ["k"], ["o"], {"n": Running("count", F.lit(1))}, parts=16)
    assert [r["n"] for r in seen.orderBy("o").collect()] == list(range(1, 20_001))
    sizes = [r["count"] for r in stored[0].groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 5_000
