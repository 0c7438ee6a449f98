"""Registered relational queries. Money sums are rounded to cents on both sides: the order of double additions differs between engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import register


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@register("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' GROUP BY n_name
""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tables; the region's filter reaches every join through the nations' keys."""
    region = table(spark, sf_dir, "region").where("r_name = 'ASIA'")
    nation = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    lines = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    bought = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    both = lines.join(bought, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return both.groupBy("n_name").agg(F.round(F.sum(_revenue()), 2).alias("revenue"))


@register("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_discount), 6) AS avg_discount, count(*) AS n_lines
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan with a pushed-down date filter and partial aggregates."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(_revenue()), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n_lines")
    )


@register("""
SELECT c_mktsegment, c_custkey, c_acctbal FROM (
  SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 3
""")
def top_customers_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top k per group: the limit is applied before the shuffle (WindowGroupLimit)."""
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, sf_dir, "customer").withColumn("place", place).where("place <= 3").select("c_mktsegment", "c_custkey", "c_acctbal")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@register("""
SELECT user_id, event_id, ts, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS)
       OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view
FROM events WHERE event_type IN ('view', 'purchase')
""")
def purchases_as_of_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join within one table: a window carries each user's last view forward."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    view = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase")).select("user_id", "event_id", "ts", "event_type", view.alias("last_view"))


@register("""
SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 2) AS total
FROM events GROUP BY ALL
""")
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over event time, without a time zone on either side."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return table(spark, sf_dir, "events").groupBy("event_type", hour).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@register("SELECT r_name, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, o_orderstatus)")
def orders_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets over counts: orders are counted by customer and status before the join, and by region before the cube."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("c"))
    counts = counts.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return counts.groupBy("r_name", "o_orderstatus").agg(F.sum("c").alias("c")).cube("r_name", "o_orderstatus").agg(F.sum("c").alias("n"))
