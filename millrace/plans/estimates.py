"""Registered queries that hold estimates against exact values, and samples that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.samples import keys_sampled, rows_of_each
from ..sources.tables import table
from .registry import register

_PLACE = "CAST('0x' || md5(concat_ws(':', '{seed}', CAST({key} AS VARCHAR)))[:8] AS BIGINT)"


def _near(estimate: str, exact: str, share: float, least: int = 1) -> Column:
    """Whether an estimate is within a share of the exact value, or within a count of ``least``."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(F.lit(float(least)), share * F.col(exact))


@register("SELECT event_type, count(DISTINCT user_id) AS exact, true AS approx_near, true AS merged_near FROM events GROUP BY event_type")
def distinct_users_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct counts, and sketches by day merged over all days: each within five standard errors of the exact count (2 % and, with 2^14 registers, 0.8 %)."""
    events = table(spark, sf_dir, "events")
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    daily = events.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.hll_sketch_agg("user_id", 14).alias("sketch"))
    merged = daily.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("merged"))
    rough = events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("rough"))
    return exact.join(rough, "event_type").join(merged, "event_type").select("event_type", "exact", _near("rough", "exact", 0.1).alias("approx_near"), _near("merged", "exact", 0.04).alias("merged_near"))


@register("""
WITH w AS (SELECT date_trunc('week', ts) AS week, user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'purchase') AS p FROM events GROUP BY ALL)
SELECT CAST(week AS TIMESTAMP) AS week, count(*) FILTER (WHERE v AND p) AS exact, true AS near FROM w GROUP BY week
""")
def buyers_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theta sketches' intersections by week, within a tenth of the viewers of the exact count: the error goes with the sets, not with what they share."""
    events = table(spark, sf_dir, "events").withColumn("week", F.date_trunc("week", "ts").cast("timestamp_ntz"))
    users = events.groupBy("week", "user_id").agg(F.bool_or(F.col("event_type") == "view").alias("v"), F.bool_or(F.col("event_type") == "purchase").alias("p"))
    exact = users.groupBy("week").agg(F.count_if(F.col("v") & F.col("p")).alias("exact"), F.count_if("v").alias("viewers"))
    sketched = events.groupBy("week").agg(F.theta_sketch_agg(F.when(F.col("event_type") == "view", F.col("user_id"))).alias("a"), F.theta_sketch_agg(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("b"))
    both = sketched.select("week", F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("both"))
    return exact.join(both, "week").select("week", "exact", (F.abs(F.col("both") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("viewers") * 0.1)).alias("near"))


@register("SELECT l_returnflag, count(*) AS n, true AS approx_near, true AS sketch_near FROM lineitem GROUP BY l_returnflag")
def price_quantiles_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate quantiles and KLL sketches of prices: of the rows, a half and nine tenths lie at or below them, to within a share of 0.02 and 0.04."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    price = F.col("l_extendedprice")
    states = lines.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", [0.5, 0.9], 10_000).alias("q"), F.expr("kll_sketch_agg_double(l_extendedprice)").alias("s"))
    marks = states.select("l_returnflag", F.col("q")[0].alias("a5"), F.col("q")[1].alias("a9"), F.expr("kll_sketch_get_quantile_double(s, 0.5D)").alias("k5"), F.expr("kll_sketch_get_quantile_double(s, 0.9D)").alias("k9"))
    shares = lines.join(F.broadcast(marks), "l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("n"), *[F.avg((price <= F.col(m)).cast("double")).alias(m) for m in ("a5", "a9", "k5", "k9")])
    return shares.select("l_returnflag", "n", ((F.abs(F.col("a5") - 0.5) <= 0.02) & (F.abs(F.col("a9") - 0.9) <= 0.02)).alias("approx_near"), ((F.abs(F.col("k5") - 0.5) <= 0.04) & (F.abs(F.col("k9") - 0.9) <= 0.04)).alias("sketch_near"))


@register(f"SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE {_PLACE.format(seed=7, key='o_orderkey')} < CAST(0.1 * 4294967296 AS BIGINT)")
def lines_of_sampled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders with all their lines: both tables are sampled by the key's hash before they are joined."""
    orders = keys_sampled(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 0.1, seed=7)
    lines = keys_sampled(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], 0.1, seed=7)
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).drop("l_orderkey")


@register(f"SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_PLACE.format(seed=3, key='o_orderkey')}, o_orderkey) <= 40")
def orders_of_each_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 40 orders of each priority."""
    return rows_of_each(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"], 40, seed=3)
