"""Samples by hashed keys against brute force; with nulls, ties, odd names and empty tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from millrace.operators.samples import keys_sampled, place, rows_of_each


def where(seed, *keys):
    return int(hashlib.md5(":".join([str(seed), *("" if k is None else str(k) for k in keys)]).encode()).hexdigest()[:8], 16)


def test_places_and_shares(spark):
    rows = [(i % 500 or None, f"k{i % 7}" if i % 11 else None, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "`a.b` int, k string, place long").repartition(5)
    got = df.withColumn("at", place(["a.b", "k"], 3)).collect()
    assert all(r["at"] == where(3, r["a.b"], r["k"]) for r in got)
    some, more = (keys_sampled(df, ["a.b"], f, seed=9) for f in (0.2, 0.4))
    assert sorted(r["place"] for r in some.collect()) == [i for a, _, i in rows if where(9, a) < 0.2 * 2**32]
    assert {r["place"] for r in some.collect()} < {r["place"] for r in more.collect()} and some.columns == df.columns
    assert keys_sampled(df, ["a.b"], 0.0).count() == 0 and keys_sampled(df, ["a.b"], 1.0).count() == 4000
    assert 0.15 < some.select("`a.b`").distinct().count() / 500 < 0.25


def test_rows_of_each_group(spark):
    rows = [(None if i % 9 == 0 else "big" if i % 5 else f"g{i % 4}", None if i % 50 == 0 else i // 2, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "`g.g` string, RANK int, n int").repartition(6)
    got = rows_of_each(df, ["g.g"], ["RANK", "n"], 30, seed=1)
    assert got.columns == df.columns
    want = []
    for g in {r[0] for r in rows}:
        want += sorted((r for r in rows if r[0] == g), key=lambda r: (where(1, r[1], r[2]), -1 if r[1] is None else r[1], r[2]))[:30]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert rows_of_each(df, ["g.g"], ["n"], 10_000).count() == 3000 and rows_of_each(df.where("false"), ["g.g"], ["n"], 3).count() == 0
    twice = spark.createDataFrame([("a", 1)] * 5, "g string, i int")
    assert rows_of_each(twice, ["g"], ["i"], 3).groupBy().agg(F.count("*")).first()[0] == 3
