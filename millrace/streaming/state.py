"""Custom state: what windows and joins of a stream can't say."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bursts(df: DataFrame, key: str, *, ts: str = "ts", at_least: int = 3, quiet_seconds: int = 3600) -> DataFrame:
    """key, began, ended and n of every burst: rows of a key, at_least of them, with less than quiet_seconds between two.

    df is a stream with a watermark on ts. A burst is given when the watermark passes
    quiet_seconds after its last row; only an open burst's three numbers are kept per key.
    Rows are taken in order of time within a trigger; a row that comes earlier than an open
    burst's last one, but not too late for the watermark, belongs to it if it is near enough.
    Rows with a null key or time are left out.
    """
    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("began", T.TimestampType()), T.StructField("ended", T.TimestampType()), T.StructField("n", T.LongType())])
    state = T.StructType([T.StructField("began", T.TimestampType()), T.StructField("ended", T.TimestampType()), T.StructField("n", T.LongType())])
    quiet = pd.Timedelta(seconds=quiet_seconds)
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")  # pandas gets times of day there

    def made(name: tuple, open_: tuple) -> pd.DataFrame:
        return pd.DataFrame({key: [name[0]], "began": [open_[0]], "ended": [open_[1]], "n": [open_[2]]})

    def step(name: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        open_ = tuple(held.get) if held.exists else None
        if held.hasTimedOut:
            held.remove()
            if open_ and open_[2] >= at_least:
                yield made(name, open_)
            return
        times = pd.concat([b[ts] for b in batches]).sort_values()
        for t in times:
            if open_ and t - open_[1] < quiet and open_[0] - t < quiet:
                open_ = (min(open_[0], t), max(open_[1], t), open_[2] + 1)
                continue
            if open_ and open_[2] >= at_least:
                yield made(name, open_)
            open_ = (t, t, 1)
        held.update(open_)
        held.setTimeoutTimestamp((open_[1].tz_localize(zone, ambiguous=False, nonexistent="shift_forward") + quiet).value // 1_000_000)

    rows = df.where(df[key].isNotNull() & df[ts].isNotNull())
    return rows.groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)
