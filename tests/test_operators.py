"""Operators that Spark lacks, against brute force and Spark's own functions."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators.intervals import overlap_join
from millrace.operators.quantiles import group_quantiles, order_statistics, trimmed_means

INF, NAN = math.inf, math.nan


def spans(seed: int) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for i in range(150):
        begin = r.uniform(-1000, 1000)
        out.append((i, r.choice("ab"), begin, begin + r.choice([0, 0.01, 1, 5, 40, 900, 5000]) * r.random()))
    return [*out, (200, "a", 3.0, 2.0), (201, "a", None, 2.0), (202, "a", 1.0, None), (203, "a", NAN, 2.0), (204, "a", -INF, 0.0), (205, "b", 0.0, INF), (206, None, 0.0, 1.0), (207, "a", 7.0, 7.0), (208, "a", 1e300, 1e301), (207, "a", 7.0, 7.0)]


def overlaps(a, b, closed) -> bool:
    if any(x is None or x != x for x in (*a, *b)) or (a[0] > a[1] or b[0] > b[1] if closed else a[0] >= a[1] or b[0] >= b[1]):
        return False
    return a[0] <= b[1] and b[0] <= a[1] if closed else a[0] < b[1] and b[0] < a[1]


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("on", [None, [("k", "m")]])
def test_overlap_join(spark, closed, on):
    a, b = spans(1), spans(2)
    left = spark.createDataFrame(a, "x long, k string, `a.b` double, e double")
    right = spark.createDataFrame(b, "y long, m string, left_low double, f double")
    got = overlap_join(left, right, ("a.b", "e"), ("left_low", "f"), on=on, closed=closed, unit=0.5)
    assert got.columns == [*left.columns, *right.columns]
    want = [(p[0], q[0]) for p in a for q in b if overlaps(p[2:], q[2:], closed) and (on is None or (p[1] == q[1] and p[1] is not None))]
    assert sorted((r["x"], r["y"]) for r in got.collect()) == sorted(want)
    assert "NestedLoop" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan


def test_overlap_join_of_times(spark):
    t = lambda h: datetime(2024, 3, 30) + timedelta(hours=h)
    a = [(1, t(0), t(5)), (2, t(5), t(5)), (3, t(100), t(5))]
    b = [(1, t(5), t(6)), (2, t(-9), t(-1)), (3, t(-50), t(50))]
    for kind in ("timestamp", "timestamp_ntz"):
        got = overlap_join(spark.createDataFrame(a, f"x long, p {kind}, q {kind}"), spark.createDataFrame(b, f"y long, r {kind}, s {kind}"), ("p", "q"), ("r", "s"))
        assert sorted((r["x"], r["y"]) for r in got.collect()) == [(1, 1), (1, 3), (2, 1), (2, 3)]
    days = overlap_join(spark.createDataFrame(a, "x long, p timestamp, q timestamp").selectExpr("x", "date(p) AS p", "date(q) AS q"), spark.createDataFrame(b, "y long, r timestamp, s timestamp").selectExpr("y", "date(r) AS r", "date(s) AS s"), ("p", "q"), ("r", "s"))
    assert sorted((r["x"], r["y"]) for r in days.collect()) == [(1, 1), (1, 3), (2, 1), (2, 3)]
    with pytest.raises(ValueError):
        overlap_join(days, days, ("p", "q"), ("r", "s"))
    none = spark.createDataFrame(a, "x long, p timestamp, q timestamp").limit(0)
    assert overlap_join(none, spark.createDataFrame(b, "y long, r timestamp, s timestamp"), ("p", "q"), ("r", "s")).count() == 0


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "b", None]), r.choice([r.gauss(0, 1), r.expovariate(1e-6), 5.0, 1e308 * r.uniform(-1, 1), 5e-324, float(r.randint(0, 9))])) for _ in range(5000)]
    rows += [("a", None), ("c", None), ("a", NAN), ("d", 7.0), ("a", INF), ("a", -INF), ("a", -INF), ("e", -0.0), ("e", 0.0)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize("limit", [10_000, 50, 1])
def test_order_statistics(values, limit):
    rows, df = values
    by: dict = {}
    for g, v in rows:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    ranks = {"least": lambda n: F.lit(0), "third": lambda n: F.floor(n / 3), "most": lambda n: n - 1}
    got = {r["g"]: tuple(r)[1:] for r in order_statistics(df, ["g"], "v", ranks, limit=limit, parts=16).collect()}
    assert got == {g: (len(x), min(x), sorted(x)[len(x) // 3], max(x)) for g, x in by.items()}


def test_quantiles_and_trimmed_means(spark, values):
    rows, _ = values
    df = spark.createDataFrame([(g, v) for g, v in rows if v is None or abs(v) < 1e9], "`g.g` string, v double")
    want = {r["k"]: r for r in df.groupBy(F.col("`g.g`").alias("k")).agg(F.percentile("v", 0.9).alias("high"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("middle")).where("high IS NOT NULL").collect()}
    got = {r["g.g"]: r for r in group_quantiles(df, ["g.g"], "v", {"high": 0.9, "middle": 0.5}, discrete=("middle",), limit=60).collect()}
    assert got.keys() == want.keys() and all(got[k]["middle"] == want[k]["middle"] and got[k]["high"] == pytest.approx(want[k]["high"]) for k in want)
    means = {r["g.g"]: r["mean"] for r in trimmed_means(df, ["g.g"], "v", limit=60).collect()}
    for g in want:
        x = sorted(v for k, v in rows if k == g and v is not None and abs(v) < 1e9)
        x = x[len(x) // 10 : len(x) - len(x) // 10]
        assert means[g] == pytest.approx(math.fsum(x) / len(x))
    assert group_quantiles(df.where("false"), ["g.g"], "v", {"m": 0.5}).count() == 0
    assert group_quantiles(df, [], "v", {"m": 0.5}).count() == 1


def test_nearest_join(spark):
    from millrace.operators.nearest import nearest_join

    r = random.Random(6)
    t = lambda: datetime(2024, 1, 1) + timedelta(seconds=r.randrange(40_000))
    a = [(i, r.choice("aab"), t()) for i in range(200)] + [(None, "a", t()), (900, None, t()), (901, "a", None)]
    b = [(i, r.choice("aab"), t()) for i in range(150)] + [(i + 300, k, at) for i, k, at in [(1, "a", a[0][2]), (2, "a", a[0][2])]] + [(None, "a", t()), (900, None, t())]
    for kind in ("timestamp", "timestamp_ntz"):
        got = nearest_join(spark.createDataFrame(a, f"x long, k string, ts {kind}"), spark.createDataFrame(b, f"y long, k string, ts {kind}"), on="k", left_time="ts", right_time="ts", left_id="x", right_id="y", within_seconds=60)
        want = {}
        for i, k, at in a:
            near = [(abs(u - at), u, j) for j, m, u in b if None not in (i, j, k, m, at, u) and k == m and abs(u - at) <= timedelta(seconds=60)]
            if near:
                want[i] = min(near)[2]
        assert {x["x"]: x["y"] for x in got.collect()} == want != {}
