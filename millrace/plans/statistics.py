"""Registered queries for aggregates: grouping sets, statistics, ordered and approximate aggregates, sketches, and aggregates in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.moments import sample_kurtosis, sample_skewness
from ..functions.udfs import geometric_mean, trimmed_mean
from ..operators.quantiles import group_quantiles, trimmed_means
from ..sources.tables import table
from .registry import register


@register("""
SELECT p_brand, p_type, p_size, count(*) AS n, CAST(grouping_id(p_brand, p_type, p_size) AS BIGINT) AS level
FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_size), ())
""")
def parts_by_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets named one by one: rows are counted by the finest key first, and only those counts are expanded."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("c"))
    sets = [[F.col("p_brand"), F.col("p_type")], [F.col("p_size")], []]
    found = counts.groupingSets(sets, "p_brand", "p_type", "p_size").agg(F.sum("c").alias("n"), F.grouping_id("p_brand", "p_type", "p_size").cast("long").alias("level"))
    return found.select("p_brand", "p_type", "p_size", "n", "level")


@register("""
SELECT l_linestatus, round(var_samp(l_quantity), 4) AS variance, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS fit, round(covar_samp(l_quantity, l_discount), 6) AS covariance
FROM lineitem GROUP BY l_linestatus
""")
def line_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variances and a least-squares line of one pass, combined before the shuffle."""
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.round(F.var_samp("l_quantity"), 4).alias("variance"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"),
        F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("fit"), F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("covariance"),
    )


@register("SELECT event_type, round(skewness(value), 5) AS skew, round(kurtosis(value), 5) AS kurtosis FROM events GROUP BY event_type")
def value_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third and fourth moments, corrected for the sample's size."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(sample_skewness("value"), 5).alias("skew"), F.round(sample_kurtosis("value"), 5).alias("kurtosis"))


@register("""
SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.9), 2) AS high, quantile_disc(o_totalprice, 0.5) AS middle, mode(o_custkey % 7 ORDER BY o_custkey % 7) AS usual,
       bool_and(o_totalprice > 0) AS all_paid, bool_or(o_totalprice > 450000) AS any_large, list_sort(list(DISTINCT o_orderstatus)) AS statuses
FROM orders GROUP BY o_orderpriority
""")
def order_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles by narrowing histograms; mode (values are counted before they meet), tests of all and any rows, and a set."""
    orders = table(spark, sf_dir, "orders")
    exact = group_quantiles(orders, ["o_orderpriority"], "o_totalprice", {"high": 0.9, "middle": 0.5}, discrete=("middle",))
    rest = orders.groupBy("o_orderpriority").agg(
        F.mode(F.col("o_custkey") % 7, True).alias("usual"), F.bool_and(F.col("o_totalprice") > 0).alias("all_paid"), F.bool_or(F.col("o_totalprice") > 450000).alias("any_large"), F.array_sort(F.collect_set("o_orderstatus")).alias("statuses")
    )
    return exact.join(rest, "o_orderpriority").select("o_orderpriority", F.round("high", 2).alias("high"), "middle", "usual", "all_paid", "any_large", "statuses")


@register("""
SELECT c_nationkey, string_agg(c_name, ',' ORDER BY c_name) AS names, arg_max(c_custkey, (c_acctbal, c_custkey)) AS richest, arg_min(c_custkey, (c_acctbal, c_custkey)) AS poorest
FROM customer WHERE c_mktsegment = 'FURNITURE' GROUP BY c_nationkey
""")
def furniture_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered concatenation, and the rows of the greatest and least value, ties broken by the key."""
    rank = F.struct("c_acctbal", "c_custkey")
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'FURNITURE'").groupBy("c_nationkey").agg(
        F.expr("listagg(c_name, ',') WITHIN GROUP (ORDER BY c_name)").alias("names"), F.max_by("c_custkey", rank).alias("richest"), F.min_by("c_custkey", rank).alias("poorest")
    )


@register("SELECT event_type, round(exp(avg(ln(value)) FILTER (WHERE value > 0)), 4) AS middle FROM events GROUP BY event_type")
def geometric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate made of built-in ones, so it combines before the shuffle."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(geometric_mean(F.col("value")), 4).alias("middle"))


@register("""
SELECT c_nationkey, round(avg(c_acctbal), 3) AS middle FROM (
  SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS place, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
WHERE place > n // 10 AND place <= n - n // 10 GROUP BY c_nationkey
""")
def trimmed_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means without each nation's lowest and highest tenth, whose ends are found by narrowing histograms: no nation's customers meet in a task."""
    return trimmed_means(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal").select("c_nationkey", F.round("mean", 3).alias("middle"))


@register("""
SELECT user_id, round(avg(value), 8) AS middle FROM (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events)
WHERE place > n // 10 AND place <= n - n // 10 GROUP BY user_id
""")
def trimmed_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an aggregate in Python over Arrow batches, for groups that are known to be small."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(trimmed_mean("value"), 8).alias("middle"))


@register()
def approximate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct counts, quantiles and frequent values: states of a bounded size, combined before the shuffle."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("users"), F.percentile_approx("value", [0.5, 0.9], 10_000).alias("quantiles"), F.expr("approx_top_k(user_id, 5)").alias("frequent")
    )


@register()
def daily_users_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of distinct users by day, stored once in practice, merged to any span of days without the events."""
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.hll_sketch_agg("user_id", 14).alias("sketch"))
    return daily.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))


@register()
def buyers_among_viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theta sketches: the size of an intersection of two sets of users without a join."""
    users = table(spark, sf_dir, "events").groupBy(F.date_trunc("week", "ts").alias("week")).agg(
        F.theta_sketch_agg(F.when(F.col("event_type") == "view", F.col("user_id"))).alias("viewers"), F.theta_sketch_agg(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers")
    )
    return users.select("week", F.theta_sketch_estimate(F.theta_intersection("viewers", "buyers")).alias("both"))


@register()
def price_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KLL sketch of prices: quantiles from a state of a bounded size."""
    sketch = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.expr("kll_sketch_agg_double(l_extendedprice)").alias("s"))
    return sketch.select("l_returnflag", F.expr("kll_sketch_get_quantile_double(s, 0.5D)").alias("middle"))
