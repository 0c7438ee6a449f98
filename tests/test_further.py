"""Recursion over cycles, row patterns over tables and functions in Python, against brute force; with nulls."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions.udfs import Runs, digit_sum
from millrace.operators.fixpoint import fixpoint


def test_digit_sum_of_nulls_and_ends(spark):
    values = [None, 0, 7, -19, 2**63 - 1, -(2**63), 1001, None]
    got = spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).select("v", digit_sum("v").alias("d")).collect()
    assert [r["d"] for r in got] == [None if v is None else sum(map(int, str(abs(v)))) for v in values]
    assert spark.createDataFrame([(None,)], "v long").select(digit_sum("v")).first()[0] is None


def test_fixpoint_ends_on_cycles(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(90)] + [(None, 5), (5, None)]
    df = spark.createDataFrame(edges, "`from` int, `to` int")
    start = spark.createDataFrame([(0,), (0,), (None,)], "`a.b` int")
    steps, at, n = {0: 0, None: 0}, {0, None}, 0
    while at:
        n += 1
        at = {b for a, b in edges if a in at} - steps.keys()
        steps |= dict.fromkeys(at, n)
    step = lambda found: found.join(df, F.col("`a.b`").eqNullSafe(F.col("from"))).select(F.col("to").alias("a.b"))
    assert {x["a.b"]: x["steps"] for x in fixpoint(start, step).collect()} == steps and len(steps) > 10
    assert {x["a.b"] for x in fixpoint(start, step, most=1).collect()} == {k for k, v in steps.items() if v <= 1}
    assert fixpoint(start.limit(0), step).count() == 0


@pytest.mark.parametrize("pattern, letters", [("view+ click purchase", "v+cp"), ("view view+ click+", "vv+c"), ("click", "c"), ("view click+ view", "vc+v")])
def test_runs_are_those_of_a_pattern(spark, pattern, letters):
    r = random.Random(5)
    kinds = {"v": "view", "c": "click", "p": "purchase", "x": None}
    rows = [(k, kinds[r.choice("vvccpx")], i) for k in ("a", "b", None) for i in range(300)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "user string, kind string, at long").repartition(5)
    want = []
    for k in ("a", "b", None):
        text = "".join({"view": "v", "click": "c", "purchase": "p", None: "x"}[kind] for _, kind, at in sorted((x for x in rows if x[0] == k), key=lambda x: x[2]))
        lazy = re.compile(letters.rstrip("+"))  # a match is given as soon as it is one
        want += [(k, m.start(), m.end() - 1, m.end() - m.start()) for m in lazy.finditer(text)]
    got = [tuple(x) for x in Runs(df.asTable(), F.lit(pattern)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) != []


def test_runs_follow_their_arguments(spark):
    df = spark.createDataFrame([(1, "a", 2.5)], "k int, kind string, o double")
    assert Runs(df.asTable(), F.lit("a")).dtypes == [("k", "int"), ("began", "double"), ("ended", "double"), ("n", "bigint")]
    with pytest.raises(PySparkException):
        Runs(df.select("k", "kind").asTable(), F.lit("a")).collect()
    with pytest.raises(PySparkException):
        Runs(df.asTable(), F.lit(" ")).collect()
    assert Runs(df.where("false").asTable(), F.lit("a")).count() == 0


def test_band_join_spreads_its_pairs(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from millrace.operators import bands

    monkeypatch.setattr(bands, "TASK_ROWS", 10)
    r = random.Random(4)
    a = [(i, r.choice(["u", "v", None]), round(r.uniform(0, 40), 1)) for i in range(400)]
    left, right = spark.createDataFrame(a, "x long, k string, p double").coalesce(1), spark.createDataFrame(a, "y long, m string, q double").coalesce(1)
    for upward in (False, True):
        got = bands.band_join(left, right, "p", "q", 0.5, on=[("k", "m")], upward=upward).withColumn("task", F.spark_partition_id()).collect()
        assert sorted((g["x"], g["y"]) for g in got) == sorted((i, j) for i, k, p in a for j, m, q in a if k == m and k and (0 if upward else -0.5) <= q - p <= 0.5)
        assert len({g["task"] for g in got}) > 20  # one task of left rows before, whose pairs nothing spread


def test_overlap_join_of_few_and_many_rows_a_key(spark):
    from millrace.operators.intervals import overlap_join

    a = [(i, "abc"[i % 3], float(i), i + 2.5) for i in range(60)] + [(90 + i, "d", float(i), i + 9.0) for i in range(3)] + [(99, None, 0.0, 9.0)]
    b = [(i, "ab"[i % 2], float(i), i + 4.0) for i in range(40)] + [(50 + i, "cdd"[i % 3], i / 2, i / 2 + 1) for i in range(30)] + [(99, None, 0.0, 9.0)]
    left, right = spark.createDataFrame(a, "x long, k string, p double, q double"), spark.createDataFrame(b, "y long, m string, r double, s double")
    want = sorted((u[0], v[0]) for u in a for v in b if u[1] == v[1] and u[1] and u[2] <= v[3] and v[2] <= u[3])
    for few in (0, 12, 25, 1000):  # all by cells; a and b by cells; none
        got = overlap_join(left, right, ("p", "q"), ("r", "s"), on=[("k", "m")], few=few)
        assert sorted((r["x"], r["y"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join ") == 1  # rows were copied to cells and joined twice before


@pytest.mark.parametrize("rows, salt", [(40, 4), (10**6, 1), (10**6, 4)])
def test_nearest_join_of_many_keys_in_one_group(spark, monkeypatch, rows, salt):
    from datetime import datetime, timedelta

    from millrace.operators import nearest

    monkeypatch.setattr(nearest, "GROUP_ROWS", rows)  # a group for each key and bucket before
    monkeypatch.setattr(nearest, "SALT", salt)
    r = random.Random(8)
    t = lambda: datetime(1970, 1, 1) + timedelta(seconds=r.randrange(-3000, 3000))
    a, b = ([(i, r.choice(["a", "b", "c", "é"]), t()) for i in range(300)] for _ in range(2))
    got = nearest.nearest_join(spark.createDataFrame(a, "x long, k string, ts timestamp"), spark.createDataFrame(b, "y long, k string, ts timestamp"), on="k", left_time="ts", right_time="ts", left_id="x", right_id="y", within_seconds=20)
    near = {i: [(abs(u - at), u, j, u - at) for j, m, u in b if k == m and abs(u - at) <= timedelta(seconds=20)] for i, k, at in a}
    want = [(i, min(x)[2], min(x)[3] // timedelta(microseconds=1)) for i, x in near.items() if x]
    assert sorted(map(tuple, got.collect())) == sorted(want) != []
    assert "[g" in got._jdf.queryExecution().executedPlan().toString()
