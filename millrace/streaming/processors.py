"""Stateful processors: state of several kinds per key, timers and expiry, kept in RocksDB."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that processors need; must be set before a stream starts.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: Ends a stream with state that expires once its files are taken; else Spark keeps running triggers to expire it.
NO_EMPTY_TRIGGERS = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}

_ROWS = T.StructType([T.StructField("at", T.LongType()), T.StructField("id", T.LongType()), T.StructField("kind", T.StringType())])
_STEPS = T.StructType([T.StructField("done", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])


class Funnel(StatefulProcessor):
    """Runs of rows whose kinds are those of steps, one right after another.

    Rows wait in a list until the watermark has passed them, so they are taken in order of
    time whatever order they came in, and by id at one time. A value holds how far the key's
    run has come, a map how many runs came that far. A timer takes what has waited, and
    clears a run that has stood still for longer than within. Each call of the state leaves
    the process, so a key has one timer for the first row that waits and not one for each,
    and its counts are read and written once a timer.
    """

    def __init__(self, steps: tuple[str, ...], within_us: int, key_name: str):
        self.steps, self.within, self.row = steps, within_us, Row(key_name, "ids", "at", "times", "begun")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROWS)
        self.run = handle.getValueState("run", _STEPS)
        self.reached = handle.getMapState("reached", "step int", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [(r["at"], r["id"], r["kind"]) for r in rows]
        self.waiting.appendList(came)
        self.handle.registerTimer(min(came)[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in rows if r[0] // 1000 + 1 <= now]
        held = self.run.get()
        if not due:
            if held and (held[1] + self.within) // 1000 + 2 <= now:
                self.run.clear()
            return
        if len(due) < len(rows):
            self.waiting.put(rows[len(due) :])
            self.handle.registerTimer(rows[len(due)][0] // 1000 + 1)
        else:
            self.waiting.clear()
        done, last, ids = (held[0], held[1], list(held[2])) if held else (0, 0, [])
        before = {k[0]: v[0] for k, v in self.reached.iterator()}
        reached = dict(before)
        for at, row, kind in due:
            if done and at - last > self.within:
                done, ids = 0, []
            done, ids = (done + 1, [*ids, row]) if kind == self.steps[done] else (1, [row]) if kind == self.steps[0] else (0, [])
            last = at
            if done:
                reached[done] = reached.get(done, 0) + 1
            if done == len(self.steps):
                yield self.row(key[0], ids, at, reached[done], reached[1])
                done, ids = 0, []
        for step, n in reached.items():
            if n != before.get(step):
                self.reached.updateValue((step,), (n,))
        if done:
            self.run.update((done, last, ids))
            self.handle.registerTimer((last + self.within) // 1000 + 2)
        elif held:
            self.run.clear()

    def close(self) -> None:
        pass


def funnels(df: DataFrame, key: str, *, steps: tuple[str, ...], kind: str = "event_type", ts: str = "ts", row_id: str = "event_id", within_seconds: int = 86_400) -> DataFrame:
    """key, ids (of the rows of each run), ended, times (runs of the key so far) and begun (first steps so far).

    df is a stream with a watermark on ts, whose rows of other kinds than steps don't count. A
    run is steps' kinds one after another, each at most within_seconds after the one before;
    it is given when the watermark passes its last row. Rows with a null key, time or kind are
    left out; rows later than the watermark are dropped.

    The session must have STORE's setting when the stream starts.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(kind).isin(*steps))
    rows = rows.select(F.col(key), F.col(ts), F.unix_micros(ts).alias("at"), F.col(row_id).cast("long").alias("id"), F.col(kind).alias("kind"))
    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("at", T.LongType()), T.StructField("times", T.LongType()), T.StructField("begun", T.LongType())])
    found = rows.groupBy(key).transformWithState(Funnel(steps, within_seconds * 1_000_000, key), out, "Append", "EventTime")
    return found.select(key, "ids", F.timestamp_micros("at").alias("ended"), "times", "begun")


class Recent(StatefulProcessor):
    """Lets a value of a key pass if it hasn't come for a while; forgotten values are dropped by the store itself.

    A key's values are read once, not asked for row by row.
    """

    def __init__(self, ttl_ms: int, names: list[str]):
        self.ttl, self.row = ttl_ms, Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "n long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = {k[0] for k in self.seen.keys()}
        for r in rows:
            if r[1] not in seen:
                seen.add(r[1])
                self.seen.updateValue((r[1],), (1,))
                yield self.row(key[0], r[1])

    def close(self) -> None:
        pass


def not_lately(df: DataFrame, key: str, value: str, *, ttl: str = "1 day") -> DataFrame:
    """key and value (text) of each row of the stream df that hasn't come within ttl of processing time before. Null keys and values are left out.

    The session must have STORE's setting when the stream starts; one that is to end by
    itself, NO_EMPTY_TRIGGERS as well.
    """
    ms = int(pd.Timedelta(ttl) / pd.Timedelta(milliseconds=1))
    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(value, T.StringType())])
    return df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value).groupBy(key).transformWithState(Recent(ms, [key, value]), out, "Append", "ProcessingTime")
