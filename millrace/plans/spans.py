"""Registered queries over intervals and over long ordered runs of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import overlap_join
from ..operators.nearest import nearest_join
from ..operators.scan import Lag, Running, scan
from ..sources.tables import table
from .registry import register


@register("""
WITH ships AS (SELECT l_orderkey AS other, o_custkey AS customer, min(l_shipdate) AS ship_from, max(l_shipdate) AS ship_to FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_orderkey, other, greatest(o_orderdate, ship_from) AS both_from, least(o_orderdate + INTERVAL 60 DAY, ship_to) AS both_to
FROM orders JOIN ships ON o_custkey = customer AND o_orderkey <> other AND o_orderdate <= ship_to AND ship_from <= o_orderdate + INTERVAL 60 DAY
""")
def waits_beside_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval-overlap join: sixty days from each order, and the spans over which the customer's other orders were shipped."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("waits_to"))
    ships = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship_from"), F.max("l_shipdate").alias("ship_to"))
    of = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("other"), F.col("o_custkey").alias("customer"))
    ships = ships.join(of, F.col("l_orderkey") == F.col("other")).drop("l_orderkey")
    met = overlap_join(orders, ships, ("o_orderdate", "waits_to"), ("ship_from", "ship_to"), on=[("o_custkey", "customer")]).where("o_orderkey <> other")
    return met.select("o_orderkey", "other", F.greatest("o_orderdate", "ship_from").alias("both_from"), F.least("waits_to", "ship_to").alias("both_to"))


@register("""
SELECT c.event_id AS click, e.event_id AS error FROM events c JOIN events e
ON c.event_type = 'click' AND e.event_type = 'error' AND c.ts < e.ts + INTERVAL 1 MINUTE * (1 + e.event_id % 20) AND e.ts < c.ts + INTERVAL 1 SECOND * (1 + power(2, c.event_id % 14)::BIGINT)
""")
def clicks_during_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval-overlap join without a key: half-open spans of seconds to hours on one side, of minutes on the other."""
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("ts").alias("from"), F.expr("ts + make_dt_interval(0, 0, 0, 1 + CAST(power(2, event_id % 14) AS BIGINT))").alias("to"))
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("error"), F.col("ts").alias("fails"), F.expr("ts + make_dt_interval(0, 0, CAST(1 + event_id % 20 AS INT), 0)").alias("works"))
    return overlap_join(clicks, errors, ("from", "to"), ("fails", "works"), closed=False).select("click", "error")


@register("""
SELECT o_orderkey, row_number() OVER w AS place, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS so_far, round(o_totalprice - lag(o_totalprice, 2) OVER w, 2) AS change
FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)
""")
def revenue_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running values over all orders as one run: a window would sort them in a single task, a scan spreads them."""
    run = scan(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), [], ["o_orderdate", "o_orderkey"], {"place": Running("count", F.lit(1)), "so_far": Running("sum", "o_totalprice"), "before": Lag("o_totalprice", 2)})
    return run.select("o_orderkey", "place", F.round("so_far", 2).alias("so_far"), F.round(F.col("o_totalprice") - F.col("before"), 2).alias("change"))


@register("""
SELECT session, min(ts) AS began, max(ts) AS ended, count(*) AS n, count(DISTINCT user_id) AS users FROM (
  SELECT *, sum(opens) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS opens FROM events))
GROUP BY session
""")
def site_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the whole site, closed by ten minutes without any event: two scans over one run of all events."""
    events = scan(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), [], ["ts", "event_id"], {"before": Lag("ts")})
    opens = F.when(F.col("ts") <= F.col("before") + F.expr("INTERVAL 10 MINUTES"), 0).otherwise(1)
    numbered = scan(events, [], ["ts", "event_id"], {"session": Running("sum", opens)})
    return numbered.groupBy("session").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@register("""
SELECT p.event_id AS purchase_id, v.event_id AS view_id, date_diff('microsecond', p.ts, v.ts) AS apart FROM events p JOIN events v
ON p.event_type = 'purchase' AND v.event_type = 'view' AND p.user_id = v.user_id AND abs(date_diff('microsecond', p.ts, v.ts)) <= 86400000000
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(date_diff('microsecond', p.ts, v.ts)), v.ts, v.event_id) = 1
""")
def views_nearest_to_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cogrouped map over users salted by days: to each purchase its user's nearest view, before or after it, within a day."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    bought = events.where("event_type = 'purchase'").withColumnRenamed("event_id", "purchase_id")
    views = events.where("event_type = 'view'").withColumnRenamed("event_id", "view_id")
    return nearest_join(bought, views, on="user_id", left_time="ts", right_time="ts", left_id="purchase_id", right_id="view_id", within_seconds=86_400)
