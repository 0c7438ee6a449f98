import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.streaming import state, windows

T0 = datetime(2024, 1, 1)
ROWS = [(1, "a", 0), (2, "a", 20), (2, "a", 20), (3, "b", 30), (4, "a", 130), (5, "b", 300)]


@pytest.fixture()
def streamed(spark, tmp_path):
    """Runs an operator over ROWS as a stream of one file and returns what it emits before the watermark holds back the rest."""

    def run(operator, *, mode="append", more=()):
        folder = tmp_path / "in"
        spark.createDataFrame([(i, u, T0 + timedelta(minutes=m)) for i, u, m in ROWS], "id long, user string, ts timestamp_ntz").coalesce(1).write.parquet(str(folder))
        for part in more:
            time.sleep(1.1)  # files are taken in order of their times
            spark.createDataFrame([(i, u, T0 + timedelta(minutes=m)) for i, u, m in part], "id long, user string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("id long, user string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(folder))
        name = f"t{abs(hash(str(tmp_path)))}"
        query = operator(windows.event_time(stream)).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(tuple(r) for r in spark.table(name).collect())

    return run


def at(m):
    return T0 + timedelta(minutes=m)


def test_tumbling(streamed):
    got = streamed(lambda df: windows.windowed(df, ["user"], [F.count("*").alias("n")]), mode="complete")
    assert got == [("a", at(0), at(60), 3), ("a", at(120), at(180), 1), ("b", at(0), at(60), 1), ("b", at(300), at(360), 1)]


def test_append_waits_for_the_watermark(streamed):
    got = streamed(lambda df: windows.windowed(df, ["user"], [F.count("*").alias("n")]))
    assert got == [("a", at(0), at(60), 3), ("a", at(120), at(180), 1), ("b", at(0), at(60), 1)]


def test_sessions(streamed):
    got = streamed(lambda df: windows.sessions(df, ["user"], [F.count("*").alias("n")]))
    assert got == [("a", at(0), at(50), 3), ("a", at(130), at(160), 1), ("b", at(30), at(60), 1)]


def test_first_seen(streamed):
    assert [r[0] for r in streamed(lambda df: windows.first_seen(df.select("id", "user", "ts"), ["id"]))] == [1, 2, 3, 4, 5]


def test_sliding(streamed):
    got = streamed(lambda df: windows.windowed(df, ["user"], [F.count("*").alias("n")], size="1 hour", slide="30 minutes"), mode="complete")
    assert [g for g in got if g[0] == "b"] == [("b", at(0), at(60), 1), ("b", at(30), at(90), 1), ("b", at(270), at(330), 1), ("b", at(300), at(360), 1)]


def test_late_rows_are_dropped_and_punctual_ones_kept(streamed):
    # the first file moves the watermark to minute 290, which holds for what comes after the second
    got = streamed(lambda df: windows.windowed(df, ["user"], [F.count("*").alias("n")]), more=[[(6, "a", 295)], [(7, "a", 10)], [(8, "b", 700)]])
    assert got == [("a", at(0), at(60), 3), ("a", at(120), at(180), 1), ("a", at(240), at(300), 1), ("b", at(0), at(60), 1), ("b", at(300), at(360), 1)]


def test_update_mode_gives_only_what_changed(streamed):
    got = streamed(lambda df: windows.windowed(df, ["user"], [F.count("*").alias("n")]), mode="update", more=[[(6, "b", 310)]])
    assert got.count(("b", at(300), at(360), 1)) == 1 and got.count(("b", at(300), at(360), 2)) == 1 and got.count(("a", at(0), at(60), 3)) == 1


def test_paired_streams(streamed):
    def both(df):
        a = df.where("id < 3").select(F.col("id").alias("left_id"), "user", F.col("ts").alias("lts"))
        b = df.where("id >= 3").select(F.col("id").alias("right_id"), "user", F.col("ts").alias("rts"))
        return windows.paired(a, b, ["user"], left_ts="lts", right_ts="rts", within="2 hours").select("left_id", "right_id")

    assert streamed(both) == [(2, 4), (2, 4)]


def test_bursts(streamed):
    got = streamed(lambda df: state.bursts(df, "user", at_least=3), more=[[(9, "c", 900)], [(9, "c", 901)]])
    assert got == [("a", at(0), at(20), 3)]


def test_paired_in_batch(spark):
    left = spark.createDataFrame([(1, "a", T0)], "id long, user string, lts timestamp")
    right = spark.createDataFrame([(7, "a", at(5)), (8, "a", at(15)), (9, "b", at(5))], "rid long, user string, rts timestamp")
    got = windows.paired(left, right, ["user"], left_ts="lts", right_ts="rts", within="10 minutes").collect()
    assert [(r["id"], r["rid"]) for r in got] == [(1, 7)]


def test_updates_of_several_triggers(spark, tmp_path):
    from millrace.streaming.run import finished, streamed

    for rows in ([("a", 1), (None, 2)], [("a", 3), ("b", 4)], [(None, 5)]):
        spark.createDataFrame(rows, "user string, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    sums = streamed(spark, str(tmp_path), "t", files=1).groupBy("user").agg(F.sum("v").alias("v"))
    assert {r["user"]: r["v"] for r in finished(sums, "sums", mode="update", keys=("user",)).collect()} == {"a": 4, "b": 4, None: 7}
    assert {r["user"]: r["v"] for r in finished(sums, "sums", mode="complete").collect()} == {"a": 4, "b": 4, None: 7}


def test_streams_of_empty_tables(spark, tmp_path):
    from millrace.plans import registry

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_hours", "stream_users", "stream_pairs"):
        assert registry.queries()[name](spark, str(tmp_path)).count() == 0
