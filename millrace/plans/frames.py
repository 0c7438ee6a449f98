"""Registered queries for window frames and ranks, set operations, recursion and scalar functions of every kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.udfs import Words, digit_sum
from ..sources.tables import table
from .registry import register


@register("""
SELECT s_nationkey, s_suppkey, dense_rank() OVER w AS dense, ntile(3) OVER w AS third, round(percent_rank() OVER w, 6) AS share, round(cume_dist() OVER w, 6) AS upto,
       lead(s_suppkey) OVER w AS next, first_value(s_suppkey) OVER w AS top, nth_value(s_suppkey, 2) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)
""")
def supplier_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rank and value function over one sort; the frame of all rows shares its partitioning."""
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "supplier").select(
        "s_nationkey", "s_suppkey", F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(3).over(w).cast("long").alias("third"), F.round(F.percent_rank().over(w), 6).alias("share"), F.round(F.cume_dist().over(w), 6).alias("upto"),
        F.lead("s_suppkey").over(w).alias("next"), F.first("s_suppkey").over(w).alias("top"), F.nth_value("s_suppkey", 2).over(every).alias("second"),
    )


@register("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type <> 'error'
""")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame by time: events of the last twelve hours of the same user."""
    events = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return spark.sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOURS PRECEDING AND CURRENT ROW) AS recent FROM {events}", events=events)


@register("""
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY date_trunc('year', o_orderdate) GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS near FROM orders
""")
def orders_of_two_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GROUPS frame, which Spark lacks: the dense rank of the peers, and a range over it."""
    ranked = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.dense_rank().over(Window.partitionBy("o_custkey").orderBy(F.year("o_orderdate"))).alias("peer"))
    return ranked.select("o_orderkey", F.count("*").over(Window.partitionBy("o_custkey").orderBy("peer").rangeBetween(-1, 0)).alias("near"))


@register("""
SELECT c_nationkey AS nation, c_name AS name, 'customer' AS kind FROM customer WHERE c_acctbal < 0
UNION ALL SELECT s_nationkey, s_name, 'supplier' FROM supplier WHERE s_acctbal < 0
""")
def in_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union by name; the filter reaches both scans."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), "c_acctbal", F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("c_acctbal"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s).where("c_acctbal < 0").select("nation", "name", "kind")


@register("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders UNION SELECT 'none', o_orderstatus FROM orders")
def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of distinct rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus")
    return orders.union(orders.select(F.lit("none"), "o_orderstatus")).distinct()


@register("""
WITH RECURSIVE up(nation, place, steps) AS (
  SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL SELECT nation, place // 2, steps + 1 FROM up WHERE place > 1)
SELECT nation, max(steps) AS steps, min(place) AS root FROM up GROUP BY nation
""")
def halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive query: each step joins the last step's rows."""
    nation = table(spark, sf_dir, "nation")
    return spark.sql("""
        WITH RECURSIVE up(nation, place, steps) AS (
          SELECT n_nationkey, n_nationkey, 0 FROM {nation} UNION ALL SELECT nation, CAST(place DIV 2 AS INT), steps + 1 FROM up WHERE place > 1)
        SELECT nation, max(steps) AS steps, min(place) AS root FROM up GROUP BY nation""", nation=nation)


@register("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_orderstatus")
def large_orders_piped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipe syntax: operators in the order in which they apply."""
    return spark.sql("FROM {orders} |> WHERE o_totalprice > 200000 |> AGGREGATE count(*) AS n GROUP BY o_orderstatus |> SELECT o_orderstatus, n", orders=table(spark, sf_dir, "orders"))


@register("""
SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS ends, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS days, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS later,
       strftime(o_orderdate, '%Y-%m') AS month, CAST(isodow(o_orderdate) AS INTEGER) AS weekday, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, CAST(extract('week' FROM o_orderdate) AS INTEGER) AS week
FROM orders WHERE o_orderpriority LIKE '1%'
""")
def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date functions, none of which depends on a time zone."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(
        "o_orderkey", F.last_day(day).alias("ends"), F.datediff(F.lit("2002-01-01").cast("date"), day).cast("long").alias("days"), F.add_months(day, 3).alias("later"), F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        (F.weekday(day) + 1).alias("weekday"), F.trunc(day, "quarter").alias("quarter"), F.weekofyear(day).alias("week"),
    )


@register("""
SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS log, CAST(floor(p_retailprice / 7) AS BIGINT) AS sevenths, p_size % 5 AS rest, greatest(p_size, 25) AS large, sign(p_size - 25)::DOUBLE AS side,
       round(power(p_size, 1.5), 4) AS grown, CAST(p_size & 12 AS INTEGER) AS bits, round(degrees(atan2(p_size, 10)), 6) AS angle
FROM part
""")
def part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic inside generated code."""
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.sqrt(price), 6).alias("root"), F.round(F.ln(price), 6).alias("log"), F.floor(price / 7).alias("sevenths"), (size % 5).alias("rest"), F.greatest(size, F.lit(25)).alias("large"), F.signum(size - 25).alias("side"),
        F.round(F.pow(size, 1.5), 4).alias("grown"), size.bitwiseAND(12).alias("bits"), F.round(F.degrees(F.atan2(size, F.lit(10))), 6).alias("angle"),
    )


@register("""
SELECT p_partkey, reverse(p_name) AS back, lpad(p_brand, 12, '*') AS padded, replace(p_type, ' ', '_') AS kind, position('a' IN p_name) AS at, md5(p_name) AS digest, left(p_name, 3) || '-' || right(p_name, 2) AS ends,
       regexp_replace(p_name, '[aeiou]', '', 'g') AS consonants, p_name ILIKE '%WIDGET%' AS widget, levenshtein(p_brand, 'Brand#11') AS away
FROM part
""")
def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String functions inside generated code."""
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.reverse(name).alias("back"), F.lpad("p_brand", 12, "*").alias("padded"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("kind"), F.instr(name, "a").cast("long").alias("at"), F.md5(name.cast("binary")).alias("digest"),
        F.concat(F.left(name, F.lit(3)), F.lit("-"), F.right(name, F.lit(2))).alias("ends"), F.regexp_replace(name, "[aeiou]", "").alias("consonants"), name.ilike("%WIDGET%").alias("widget"), F.levenshtein("p_brand", F.lit("Brand#11")).cast("long").alias("away"),
    )


@register("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) AS square, len(list_filter(embedding, lambda x: x > 0)) AS above,
       round(list_dot_product(CAST(embedding[1:8] AS DOUBLE[]), CAST(embedding[9:16] AS DOUBLE[])), 4) AS folded, list_position(embedding, list_max(embedding)) AS peak
FROM embeddings
""")
def vector_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Higher-order functions over arrays: transform, filter, zip_with and aggregate."""
    v = F.col("embedding")
    dot = F.aggregate(F.zip_with(F.slice(v, 1, 8), F.slice(v, 9, 8), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x), 5).alias("square"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("above"), F.round(dot, 4).alias("folded"), F.array_position(v, F.array_max(v)).cast("int").alias("peak")
    )


@register("""
SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS asked, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS answered FROM conversations GROUP BY conv_id
""")
def conversation_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map functions: a map of each role's turns and characters, looked up by role."""
    by_role = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    maps = by_role.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", F.struct("turns", "chars")))).alias("m"))
    return maps.select("conv_id", F.coalesce(F.map_filter("m", lambda k, v: v["turns"] > 0)["user"]["turns"], F.lit(0)).cast("long").alias("asked"), F.coalesce(F.col("m")["assistant"]["chars"], F.lit(0)).cast("long").alias("answered"))


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AS has, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS next FROM events")
def event_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-structured values: parsed once to VARIANT, then read by path; and the same by path from the text."""
    parsed = table(spark, sf_dir, "events").select("event_id", "props", F.parse_json("props").alias("v"))
    return parsed.select("event_id", F.variant_get("v", "$.k", "long").alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("has"), (F.try_variant_get("v", "$.k", "long") + 1).alias("next"))


@register("SELECT event_id, '{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' AS said, hour(ts) * 60 + minute(ts) AS minute FROM events")
def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to JSON text, and the time of day."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("said"), (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("minute")
    )


@register("""
SELECT o_orderstatus, part, n FROM (SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice >= 200000) AS large, count(*) FILTER (WHERE o_totalprice < 200000) AS small FROM orders GROUP BY o_orderstatus)
UNPIVOT (n FOR part IN (large, small))
""")
def orders_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stack(): several rows out of one, after the aggregate."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") >= 200000).alias("large"), F.count_if(F.col("o_totalprice") < 200000).alias("small"))
    return counts.select("o_orderstatus", F.stack(F.lit(2), F.lit("large"), "large", F.lit("small"), "small").alias("part", "n"))


@register("SELECT item_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS place, unnest(w) AS word FROM (SELECT item_id, regexp_split_to_array(trim(text, ' \t\n\r'), '[ \t\n\r]+') AS w FROM benchmark WHERE text <> '')")
def benchmark_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function in Python, joined laterally to each row."""
    return table(spark, sf_dir, "benchmark").where("text <> ''").lateralJoin(Words(F.col("text").outer())).select("item_id", "place", "word")


@register("SELECT o_orderkey, list_sum(list_transform(string_split(CAST(o_custkey AS VARCHAR), ''), lambda c: CAST(c AS BIGINT)))::BIGINT AS digits FROM orders WHERE o_orderstatus = 'P'")
def customer_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function in Python over Arrow batches; the filter runs before it."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", digit_sum("o_custkey").alias("digits"))
