"""Registered queries that run as streams: watermarks, windows, sessions, output modes, joins and custom state.

Each takes the events as a stream, runs until every file is taken and gives what was
emitted. The watermark is then ten minutes, in whole milliseconds, before the last event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming.processors import NO_EMPTY_TRIGGERS, STORE, funnels, not_lately
from ..streaming.run import configured, finished, in_files, in_triggers, streamed
from ..streaming.state import bursts
from ..streaming.windows import event_time, first_seen, paired, sessions, windowed
from .registry import register

_WATERMARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"


def _plain_times(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})


@register(f"""
SELECT event_type, began, began + INTERVAL 1 HOUR AS ended, count(*) AS n, max(user_id) AS most FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS began FROM events)
WHERE began + INTERVAL 1 HOUR <= {_WATERMARK} GROUP BY event_type, began
""")
def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows in append mode: those that the watermark has passed."""
    found = windowed(event_time(streamed(spark, sf_dir, "events")), ["event_type"], [F.count("*").alias("n"), F.max("user_id").alias("most")])
    return _plain_times(finished(found, "stream-hours"), "began", "ended")


@register("""
SELECT event_type, began, began + INTERVAL 6 HOUR AS ended, count(*) AS n
FROM (SELECT event_type, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS began FROM events) GROUP BY ALL
""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows in complete mode: all of them, the open ones too."""
    found = windowed(event_time(streamed(spark, sf_dir, "events")), ["event_type"], [F.count("*").alias("n")], size="6 hours", slide="3 hours")
    return _plain_times(finished(found, "stream-sliding", mode="complete"), "began", "ended")


@register("SELECT user_id, count(*) AS n, max(ts) AS seen, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY user_id")
def stream_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running aggregate in update mode, a row for each user that changed, and of these rows the last ones."""
    found = streamed(spark, sf_dir, "events", files=1).groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("seen"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    return finished(found, "stream-users", mode="update", keys=("user_id",))


@register(f"""
WITH s AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true) AS new FROM events),
k AS (SELECT user_id, ts, count(*) FILTER (WHERE new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM k GROUP BY user_id, k HAVING ended <= {_WATERMARK}
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows in append mode: those that the watermark has passed."""
    found = sessions(event_time(streamed(spark, sf_dir, "events")), ["user_id"], [F.count("*").alias("n")])
    return _plain_times(finished(found, "stream-sessions"), "began", "ended")


@register("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's kinds of events, each once within the watermark's delay; all files come in one trigger."""
    return finished(first_seen(event_time(streamed(spark, sf_dir, "events")), ["user_id", "event_type"]), "stream-first").select("user_id", "event_type")


@register("""
SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR
""")
def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined by user and interval; both watermarks bound what is kept."""
    views = event_time(streamed(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("viewed")), "viewed")
    purchases = event_time(streamed(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought")), "bought")
    return finished(paired(views, purchases, ["user_id"], left_ts="viewed", right_ts="bought", within="1 hour").select("view_id", "purchase_id"), "stream-pairs")


@register(f"""
WITH s AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS new FROM events WHERE user_id IS NOT NULL),
k AS (SELECT user_id, ts, count(*) FILTER (WHERE new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s),
b AS (SELECT user_id, k, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM k GROUP BY user_id, k)
SELECT user_id, began, ended, n FROM (SELECT *, max(k) OVER (PARTITION BY user_id) AS last FROM b)
WHERE n >= 3 AND (k < last OR date_trunc('millisecond', ended) + INTERVAL 6 HOUR < {_WATERMARK})
""")
def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom state: a user's bursts, given when a later event or the watermark ends them."""
    return _plain_times(finished(bursts(event_time(streamed(spark, sf_dir, "events")), "user_id", quiet_seconds=6 * 3600), "stream-bursts"), "began", "ended")


@register(f"""
WITH s AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS t1, lag(event_type, 2) OVER w AS t2, lag(ts) OVER w AS s1, lag(ts, 2) OVER w AS s2, lag(event_id) OVER w AS e1, lag(event_id, 2) OVER w AS e2
  FROM events WHERE event_type IN ('view', 'click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT user_id, e2 AS view_id, e1 AS click_id, event_id AS purchase_id, ts AS ended FROM s WHERE event_type = 'purchase' AND t1 = 'click' AND t2 = 'view' AND ts <= s1 + INTERVAL 7 DAY AND s1 <= s2 + INTERVAL 7 DAY AND ts < {_WATERMARK})
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ended) AS times, (SELECT count(*) FROM events v WHERE v.user_id = p.user_id AND event_type = 'view' AND v.ts < ended) AS begun FROM p
""")
def stream_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom state of several kinds with timers: a user's view, click and purchase one after another, over four triggers."""
    with configured(spark, STORE):
        events = event_time(in_files(table(spark, sf_dir, "events"), "ts", 4, "funnel-events"))
        found = finished(funnels(events, "user_id", steps=("view", "click", "purchase"), within_seconds=7 * 86_400), "stream-funnels")
    ids = F.col("ids")
    return _plain_times(found.select("user_id", ids[0].alias("view_id"), ids[1].alias("click_id"), ids[2].alias("purchase_id"), "ended", "times", "begun"), "ended")


@register("SELECT DISTINCT user_id, event_type FROM events")
def stream_kinds_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State that expires: a user's kinds of events, each once in a while, over four triggers."""
    with configured(spark, STORE | NO_EMPTY_TRIGGERS):
        return finished(not_lately(in_files(table(spark, sf_dir, "events"), "ts", 4, "kinds-events"), "user_id", "event_type"), "stream-kinds")


@register(f"""
WITH lone AS (SELECT v.ts FROM events v WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR))
SELECT began, began + INTERVAL 1 DAY AS ended, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS began FROM lone) GROUP BY began
HAVING began + INTERVAL 1 DAY + INTERVAL 1 HOUR < least((SELECT max(ts) FROM events WHERE event_type = 'view'), (SELECT max(ts) FROM events WHERE event_type = 'purchase')) - INTERVAL 20 MINUTE
""")
def stream_lone_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer interval join of two streams, and windows counted over what it gives: days' views that no purchase followed within the hour, over four triggers."""
    views = event_time(in_files(table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", F.col("ts").alias("viewed")), "viewed", 4, "lone-views"), "viewed")
    purchases = event_time(in_files(table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought")), "bought", 4, "lone-purchases"), "bought")
    lone = paired(views, purchases, ["user_id"], left_ts="viewed", right_ts="bought", within="1 hour", how="left").where("bought IS NULL")
    days = windowed(lone, [], [F.count("*").alias("n")], ts="viewed", size="1 day")
    return _plain_times(finished(days, "stream-lone"), "began", "ended")


@register(f"""
SELECT began, began + INTERVAL 1 HOUR AS ended, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS began FROM events WHERE NOT (event_id % 20 = 0 AND day(ts) <= 8))
WHERE began + INTERVAL 1 HOUR <= {_WATERMARK} GROUP BY began
""")
def stream_without_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows dropped: over four triggers of eight days each, every twentieth event of the first eight days comes with the last ones, whose watermark is weeks past."""
    events = table(spark, sf_dir, "events")
    came = F.when((F.col("event_id") % 20 == 0) & (F.dayofmonth("ts") <= 8), 3).otherwise(F.floor((F.dayofmonth("ts") - 1) / 8))
    found = windowed(event_time(in_triggers(events.withColumn("came", came), "came", 4, "late-events")), [], [F.count("*").alias("n")])
    return _plain_times(finished(found, "stream-without-late"), "began", "ended")


@register("SELECT event_id, user_id, ts FROM events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are sent again with the eight days that follow, over five triggers: each once, the state kept for as long as copies can come."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor((F.dayofmonth("ts") - 1) / 8).alias("came"))
    sent = events.unionAll(events.withColumn("came", F.col("came") + 1))
    return _plain_times(finished(first_seen(event_time(in_triggers(sent, "came", 5, "sent-twice"), late="16 days"), ["event_id"]), "stream-once"), "ts")
