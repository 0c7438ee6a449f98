"""Stateful processors over several triggers, restarted from their checkpoint in between."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.streaming import windows
from millrace.streaming.processors import NO_EMPTY_TRIGGERS, STORE, funnels, not_lately
from millrace.streaming.run import configured

T0 = datetime(2024, 1, 1)
STEPS = ("view", "click", "purchase")


def brute(rows: list[tuple], until: datetime, within: timedelta) -> list[tuple]:
    out = []
    for user in {r[2] for r in rows} - {None}:
        done: list[tuple] = []
        for ts, i, _, kind in sorted(r for r in rows if r[2] == user and r[0] is not None and r[3] in STEPS and r[0] < until):
            if done and ts - done[-1][0] > within:
                done = []
            done = [*done, (ts, i)] if kind == STEPS[len(done)] else [(ts, i)] if kind == STEPS[0] else []
            if len(done) == 3:
                out.append((user, [x[1] for x in done], ts))
                done = []
    return sorted(out)


def test_funnels_over_triggers_and_a_restart(spark, tmp_path):
    r = random.Random(7)
    rows = [(T0 + timedelta(minutes=3 * i + r.randint(-9, 0)), i, r.choice("abc"), r.choice([*STEPS, "error"])) for i in range(240)]
    rows += [(T0, 900, None, "view"), (None, 901, "a", "view"), (T0, 902, "b", None)]
    folder, within = tmp_path / "in", timedelta(minutes=60)

    def put(part: list[tuple]) -> None:
        spark.createDataFrame(part, "ts timestamp, event_id long, user string, event_type string").coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are taken in order of their times

    def run() -> None:
        stream = windows.event_time(spark.readStream.schema("ts timestamp, event_id long, user string, event_type string").option("maxFilesPerTrigger", 1).parquet(str(folder)), late="15 minutes")
        with configured(spark, STORE):
            query = funnels(stream, "user", steps=STEPS, within_seconds=3600).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
            assert query.awaitTermination(150)

    for part in (rows[:60], rows[60:120]):
        put(part)
    run()
    for part in (rows[120:180], rows[180:]):
        put(part)
    run()
    until = max(x[0] for x in rows if x[0]) - timedelta(minutes=15)
    got = sorted((x["user"], x["ids"], x["ended"]) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == brute(rows, until, within) != []
    late = (T0, 999, "a", "view")
    put([late])
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)


def test_values_expire(spark, tmp_path):
    folder = tmp_path / "in"

    def run() -> None:
        stream = spark.readStream.schema("user string, kind string").parquet(str(folder))
        with configured(spark, STORE | NO_EMPTY_TRIGGERS):
            query = not_lately(stream, "user", "kind", ttl="20 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
            assert query.awaitTermination(100)

    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), (None, "x"), ("b", None)], "user string, kind string")
    rows.write.mode("append").parquet(str(folder))
    run()
    got = lambda: {(r["user"], r["kind"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("user", "kind").agg(F.count("*").alias("n")).collect()}
    assert got() == {("a", "x"): 1, ("a", "y"): 1}
    time.sleep(21)
    rows.write.mode("append").parquet(str(folder))
    run()
    assert got() == {("a", "x"): 2, ("a", "y"): 2}


def test_triggers_are_written_in_several_files(spark, monkeypatch):
    from millrace.streaming import run

    monkeypatch.setattr(run, "FILE_ROWS", 20)
    rows = spark.createDataFrame([(i, i // 100 if i < 205 else 3) for i in range(300)], "x long, part int")  # trigger 2 has five rows, fewer than files; 4 has none
    stream = run.in_triggers(rows, "part", 5, "several")
    taken = []
    query = stream.writeStream.foreachBatch(lambda b, i: taken.append((i, sorted(r["x"] for r in b.collect()), b.rdd.getNumPartitions()))).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    want = [list(range(100)), list(range(100, 200)), list(range(200, 205)), list(range(205, 300)), []]
    assert [t[1] for t in taken] == want and taken[0][2] > 1  # one file and one task a trigger before
    got = []
    query = run.in_files(spark.range(400).repartition(3), "id", 4, "ranges").writeStream.foreachBatch(lambda b, i: got.append(sorted(r["id"] for r in b.collect()))).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    assert len(got) == 4 and sum(got, []) == list(range(400))


def test_calls_of_the_state_follow_keys_not_rows():
    from pyspark.sql import Row

    from millrace.streaming.processors import Funnel, Recent

    calls = []

    class Kept:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or []

    class Handle(Kept):
        getListState = getValueState = getMapState = lambda *_: Kept()

    funnel = Funnel(STEPS, 60_000_000, "user")
    funnel.init(Handle())
    list(funnel.handleInputRows(("a",), (Row(at=i * 10**6, id=i, kind="view") for i in range(500)), None))
    assert calls == ["appendList", "registerTimer"]  # a timer for each row before
    calls.clear()
    recent = Recent(1000, ["user", "kind"])
    recent.init(Handle())
    assert len(list(recent.handleInputRows(("a",), (Row(user="a", kind="xyz"[i % 3]) for i in range(500)), None))) == 3
    assert len(calls) == 4  # two for each row before
