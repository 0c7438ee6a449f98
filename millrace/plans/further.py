"""Registered queries: recursion over cycles, variant rows, and table functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udfs import Runs
from ..operators.fixpoint import fixpoint
from ..sources.tables import table
from .registry import register


@register("""
WITH RECURSIVE l AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_quantity >= 49),
r(part, steps) AS (SELECT DISTINCT part, 0 FROM l WHERE part <= 3 UNION SELECT b.part, steps + 1 FROM r JOIN l a ON a.part = r.part JOIN l b ON b.supp = a.supp WHERE steps < 12)
SELECT part, CAST(min(steps) AS INTEGER) AS steps FROM r GROUP BY part
""")
def parts_by_common_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursion over a graph full of cycles: steps from the first parts to others over suppliers of large lots of both. Suppliers are stepped over as well, so their pairs of parts are never listed."""
    lots = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).distinct()
    start = lots.where("part <= 3").select(F.lit("part").alias("kind"), F.col("part").alias("key"))

    def step(found: DataFrame) -> DataFrame:
        to_supp = found.where("kind = 'part'").join(lots, F.col("key") == F.col("part")).select(F.lit("supp").alias("kind"), F.col("supp").alias("key"))
        return to_supp.unionByName(found.where("kind = 'supp'").join(lots, F.col("key") == F.col("supp")).select(F.lit("part").alias("kind"), F.col("part").alias("key")))

    reached = fixpoint(start, step, most=24)
    return reached.where("kind = 'part'").select(F.col("key").alias("part"), (F.col("steps") / 2).cast("int").alias("steps"))


@register("""
SELECT event_id, place, CASE place WHEN 0 THEN CAST(user_id AS BIGINT) WHEN 1 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE event_id % 3 END AS n, CASE place WHEN 0 THEN 'user' WHEN 1 THEN 'prop' ELSE 'rest' END AS name
FROM events, (SELECT unnest([0, 1, 2])::INTEGER AS place) WHERE place < 2 OR event_id % 3 > 0
""")
def event_variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows out of nested values of no fixed shape: an array in a variant, exploded laterally and read by path; some events' arrays are shorter."""
    events = table(spark, sf_dir, "events")
    item = lambda name, n: F.struct(F.lit(name).alias("name"), F.struct(n.cast("long").alias("n")).alias("of"))
    items = F.array(item("user", F.col("user_id")), item("prop", F.get_json_object("props", "$.k")), item("rest", F.col("event_id") % 3))
    items = F.when(F.col("event_id") % 3 > 0, items).otherwise(F.slice(items, 1, 2))
    nested = events.select("event_id", F.parse_json(F.to_json(F.struct(items.alias("items")))).alias("v"))
    return spark.sql("SELECT event_id, pos AS place, value:of.n::bigint AS n, value:name::string AS name FROM {nested}, LATERAL variant_explode(v:items)", nested=nested)


@register("""
SELECT event_type, CASE WHEN event_type = 'error' THEN 'OBJECT<code: BIGINT, k: BIGINT>' ELSE 'OBJECT<k: BIGINT>' END AS shape, count(*) AS n FROM events GROUP BY event_type
""")
def event_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape that all of a group's variants have in common, found by an aggregate."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    text = F.when(F.col("event_type") == "error", F.to_json(F.struct(k.alias("k"), F.col("user_id").alias("code")))).otherwise(F.to_json(F.struct(k.alias("k"))))
    return events.select("event_type", F.parse_json(text).alias("v")).groupBy("event_type").agg(F.schema_of_variant_agg("v").alias("shape"), F.count("*").alias("n"))


@register("""
WITH s AS (SELECT user_id, ts, event_type, row_number() OVER w AS i, lag(event_type) OVER w AS t1, lag(event_type, 2) OVER w AS t2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, coalesce(max(CASE WHEN event_type <> 'view' THEN i END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS stop FROM s)
SELECT p.user_id, f.ts AS began, p.ts AS ended, p.i - f.i + 1 AS n FROM s p JOIN b v ON v.user_id = p.user_id AND v.i = p.i - 2 JOIN s f ON f.user_id = p.user_id AND f.i = v.stop + 1
WHERE p.event_type = 'purchase' AND p.t1 = 'click' AND p.t2 = 'view'
""")
def viewed_then_bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row patterns by a table function over a partitioned and ordered table: one or more views, a click, a purchase."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    return Runs(rows.asTable(), F.lit("view+ click purchase"))
