"""Registered queries for the kinds of joins: forced strategies, theta, cross, lateral, as-of of two tables, and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import asof_join
from ..operators.bands import band_join
from ..sources.tables import table
from .registry import register


@register("SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 100000 GROUP BY o_orderpriority")
def quantities_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort-merge join of two large tables, asked for by hint: neither side has to fit in memory."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    both = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@register("SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY p_brand")
def lines_of_small_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled hash join: the filtered side is hashed partition by partition, and the large one isn't sorted."""
    part = table(spark, sf_dir, "part").where("p_size < 10").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey")
    return lines.join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"))


@register("""
SELECT c_custkey, r_name, low FROM customer JOIN (SELECT r_name, (r_regionkey * 2000)::DOUBLE AS low FROM region) ON c_acctbal >= low AND c_acctbal < low + 2000 WHERE c_mktsegment = 'MACHINERY'
""")
def customers_by_balance_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theta join. The inner side is the table of regions, of a handful of rows whatever the scale, so it goes to every task."""
    bands = table(spark, sf_dir, "region").select("r_name", (F.col("r_regionkey") * F.lit(2000.0)).alias("low"))
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_acctbal")
    inside = (F.col("c_acctbal") >= F.col("low")) & (F.col("c_acctbal") < F.col("low") + 2000)
    return customers.join(F.broadcast(bands), inside).select("c_custkey", "r_name", "low")


@register("""
SELECT a.p_partkey AS part, b.p_partkey AS other FROM part a JOIN part b
ON a.p_brand = b.p_brand AND b.p_retailprice > a.p_retailprice AND b.p_retailprice <= a.p_retailprice + 0.5
""")
def parts_of_like_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join of two large sides through a grid of prices, not by comparing every pair of a brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    other = part.toDF("other", "other_brand", "other_price")
    near = band_join(part, other, "p_retailprice", "other_price", 0.5, on=[("p_brand", "other_brand")], upward=True)
    return near.where("other_price > p_retailprice").select(F.col("p_partkey").alias("part"), "other")


@register("""
SELECT r_name, segment, count(c_custkey) AS n FROM region CROSS JOIN (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS segment)
JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = segment GROUP BY r_name, segment
""")
def customers_by_region_and_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid without gaps: the cross product of two fixed lists, joined to counts that are made before."""
    segments = spark.createDataFrame([(s,) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")], "segment string")
    grid = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).crossJoin(F.broadcast(segments))
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("c"))
    found = grid.join(counts, (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("segment") == F.col("c_mktsegment")), "left")
    return found.groupBy("r_name", "segment").agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"))


@register("""
SELECT n_name, c_custkey, c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2)
""")
def richest_of_each_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lateral subquery with a limit, said in SQL; Spark turns it into a limit by group."""
    named = {n: table(spark, sf_dir, n) for n in ("nation", "customer")}
    return spark.sql("SELECT n_name, c_custkey, c_acctbal FROM {nation}, LATERAL (SELECT c_custkey, c_acctbal FROM {customer} WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2)", **named)


@register("""
SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id, v.ts AS viewed FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def views_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join of two tables: each purchase with its user's latest view before it, or none."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("viewed"))
    return asof_join(bought, views, on=["user_id"], left_time="ts", right_time="viewed", bucket="1 day").select("event_id", "user_id", "ts", "view_id", "viewed")


@register()
def sampled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeatable sample of about a tenth of the lines; what it takes is left to Spark, so there is no SQL beside it."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").sample(fraction=0.1, seed=7)
