"""Registered queries over tables that are first written in other formats: Spark's own and the connector of Arrow files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits
from ..sources.shared import stash_path
from ..sources.tables import read, table, write
from .registry import register

#: Spark's formats that hold rows of several columns, and what each needs to be told.
_ROWS = {"orc": {}, "json": {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}, "csv": {"header": True, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}, "xml": {"rowTag": "row"}}


@register("""
SELECT f.format, o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first, max(o_orderdate) AS last
FROM orders, (VALUES ('orc'), ('json'), ('csv'), ('xml')) AS f(format) GROUP BY f.format, o_orderstatus
""")
def orders_through_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders written in every format of rows and read again by their schema, without inferring."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    found = []
    for name, options in _ROWS.items():
        path = stash_path(spark, f"orders-{name}")
        write(orders, name, path, **options)
        counts = read(spark, name, path, orders.schema, **options).groupBy("o_orderstatus")
        found.append(counts.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last")).select(F.lit(name).alias("format"), "*"))
    return reduce(DataFrame.unionAll, found)


@register("SELECT role, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT role, unnest(string_split(text, chr(10))) AS line FROM conversations) GROUP BY role")
def lines_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as plain lines into a folder for each role, and read by their folders' names."""
    path = stash_path(spark, "lines-by-role")
    write(table(spark, sf_dir, "conversations").select("role", F.col("text").alias("value")), "text", path, partition_by=("role",))
    return read(spark, "text", path, "value string, role string").groupBy("role").agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("chars"))


@register("""
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01' AND o_totalprice > 100000 GROUP BY o_orderstatus
""")
def orders_of_half_a_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrow files by ranges of dates: the log's bounds leave the half-year's files to read, and of these three columns."""
    commits.register(spark)
    path = stash_path(spark, "orders-by-date")
    table(spark, sf_dir, "orders").repartitionByRange(16, "o_orderdate").write.format("commits").mode("append").save(path)
    found = spark.read.format("commits").schema("o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz").load(path)
    half = found.where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01' AND o_orderdate < TIMESTAMP_NTZ '1997-07-01' AND o_totalprice > 100000")
    return half.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events, round(sum(value), 4) AS total, max(ts) AS last FROM events WHERE event_type <> 'error' GROUP BY event_type")
def stream_copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream from a log of commits to another, started again after each of three commits: every event once."""
    commits.register(spark)
    source, sink, state = (stash_path(spark, f"copied-{n}") for n in ("source", "sink", "state"))
    events = table(spark, sf_dir, "events")
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).write.format("commits").mode("append").save(source)
        copied = spark.readStream.format("commits").load(source).where("event_type <> 'error'")
        copied.writeStream.format("commits").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.format("commits").load(sink).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last"))
