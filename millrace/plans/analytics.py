"""Further relational queries: join kinds, grouping sets, set operations, reshaping, windows and scalar functions.

Doubles are rounded and integers cast on both sides where the engines' results differ in type or last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import register


@register("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09)")
def suppliers_with_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-join: the filter on the large side is pushed to its scan."""
    lines = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select("l_suppkey")
    return table(spark, sf_dir, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@register("""
SELECT c_nationkey, s_nationkey, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers
FROM (SELECT c_nationkey, count(*) AS n_customers FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey)
FULL OUTER JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY s_nationkey) ON c_nationkey = s_nationkey
""")
def nations_on_either_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join of two aggregates that are already partitioned by its keys."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count("*").alias("n_customers"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n_suppliers"))
    both = c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select("c_nationkey", "s_nationkey", zero("n_customers"), zero("n_suppliers"))


@register("""
SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b
ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'
""")
def purchases_within_an_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join. The hour is part of the key and views are entered under two hours, so a busy user's events don't all meet."""
    events = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    a = events.where("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("ts").alias("from"), F.col("event_id").alias("first_id"), F.explode(F.array(hour, hour + F.expr("INTERVAL 1 HOUR"))).alias("h"))
    b = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("second_id"), hour.alias("hour"))
    near = (F.col("u") == F.col("user_id")) & (F.col("h") == F.col("hour")) & (F.col("ts") > F.col("from")) & (F.col("ts") <= F.col("from") + F.expr("INTERVAL 1 HOUR"))
    return a.join(b, near).select("first_id", "second_id")


@register("SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY ROLLUP (p_brand, p_type)")
def parts_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@register("""
SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS n_large, count(DISTINCT o_custkey) AS customers,
       min(o_orderdate) AS first_date, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS largest
FROM orders GROUP BY o_orderstatus
""")
def orders_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered, distinct and arg-max aggregates in one pass."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count_if(F.col("o_totalprice") > 200000).alias("n_large"), F.countDistinct("o_custkey").alias("customers"), F.min("o_orderdate").alias("first_date"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("largest")
    )


@register("SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT ALL SELECT s_nationkey FROM supplier")
def nations_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_nationkey")
    return c.intersectAll(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey")))


@register("SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def nations_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_nationkey").exceptAll(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey")))


@register("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view,
       count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id
""")
def events_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot with its values named, so Spark needn't look for them first."""
    kinds = ["click", "view", "purchase"]
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count("event_id"))
    return wide.select("user_id", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in kinds])


@register("""
SELECT l_orderkey, 'discount' AS kind, round(sum(l_discount), 4) AS amount FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT l_orderkey, 'tax' AS kind, round(sum(l_tax), 4) AS amount FROM lineitem GROUP BY l_orderkey
""")
def rates_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpivot after the aggregate: the table is read and shuffled once."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_discount"), 4).alias("discount"), F.round(F.sum("l_tax"), 4).alias("tax"))
    return sums.unpivot("l_orderkey", ["discount", "tax"], "kind", "amount")


@register("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def events_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.from_json("props", "k long")["k"] % 10).alias("k")
    return table(spark, sf_dir, "events").groupBy("event_type", k).agg(F.count("*").alias("n"))


@register("""
SELECT o_custkey, o_orderkey, CAST(rank() OVER w AS INTEGER) AS place, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS change,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, lag and a moving sum over one sort of each customer's orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.rank().over(w).alias("place"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("change"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last_three")
    )


@register("""
SELECT user_id, session, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM (
  SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS session FROM (
    SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events))
GROUP BY user_id, session
""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions closed by six hours of silence; both windows and the aggregate use one shuffle by user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    quiet = F.col("ts") <= F.lag("ts").over(w) + F.expr("INTERVAL 6 HOURS")
    opened = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(quiet, 0).otherwise(1).alias("opens"))
    numbered = opened.withColumn("session", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n"))


@register("""
SELECT l_returnflag, median(l_quantity) AS middle, round(stddev_samp(l_extendedprice), 2) AS deviation, round(corr(l_quantity, l_extendedprice), 6) AS correlation
FROM lineitem GROUP BY l_returnflag
""")
def line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistical aggregates. The median counts by value before it meets in a task."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.median("l_quantity").alias("middle"), F.round(F.stddev_samp("l_extendedprice"), 2).alias("deviation"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("correlation"))


@register("""
SELECT upper(split_part(p_name, ' ', 1)) AS word, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS brand, CAST(max(length(p_name)) AS INTEGER) AS longest, count(*) AS n
FROM part WHERE p_name LIKE '%widget%' GROUP BY ALL
""")
def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String functions and patterns, all of them inside generated code."""
    part = table(spark, sf_dir, "part").where(F.col("p_name").like("%widget%"))
    return part.groupBy(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("word"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("brand")).agg(F.max(F.length("p_name")).alias("longest"), F.count("*").alias("n"))


@register("""
SELECT lower(word) AS word, count(*) AS n, count(DISTINCT item_id) AS items
FROM (SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark) WHERE word <> '' GROUP BY lower(word)
""")
def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explode, then a plain and a distinct count of every word."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    return words.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"))


@register("""
SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id
""")
def conversation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered concatenation: an array of each conversation's turns, sorted within the aggregate's result."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(turns, lambda t: t["role"]), ">").alias("roles"))


@register("""
WITH RECURSIVE days(day) AS (SELECT TIMESTAMP '2024-01-01' UNION ALL SELECT day + INTERVAL 1 DAY FROM days WHERE day < TIMESTAMP '2024-01-30')
SELECT day, count(event_id) AS n FROM days LEFT JOIN events ON date_trunc('day', ts) = day GROUP BY day
""")
def events_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar without gaps: generated days joined with daily counts, which are made before the join."""
    days = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-30', INTERVAL 1 DAY)) AS day")
    counts = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d")).agg(F.count("*").alias("c"))
    return days.join(counts, F.col("d") == F.col("day"), "left").select("day", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


@register("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def richest_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: each task keeps its best rows (TakeOrderedAndProject); the limit is what is asked for."""
    return table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25).select("c_custkey", "c_name", "c_acctbal")
