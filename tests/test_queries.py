import math

import duckdb
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "benchmark", "conversations", "embeddings")


def plain(rows) -> list[tuple]:
    return sorted((tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    assert got.columns == want.columns
    assert plain(got.collect()) == plain(want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(registry.queries()) <= set(__spark_entry__.queries())


def test_formats_round_trip(spark, tmp_path):
    from millrace.sources.tables import read, write

    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    for fmt in ("parquet", "orc", "json", "csv"):
        write(df, fmt, str(tmp_path / fmt))
        assert plain(read(spark, fmt, str(tmp_path / fmt), df.schema).collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        read(spark, "nothing", "x")


def test_text_and_xml_round_trip(spark, tmp_path):
    from millrace.sources.tables import read, write

    df = spark.createDataFrame([("a b",), ("c",)], "value string")
    write(df, "text", str(tmp_path / "text"))
    assert plain(read(spark, "text", str(tmp_path / "text")).collect()) == [("a b",), ("c",)]
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    write(df, "xml", str(tmp_path / "xml"), rowTag="row")
    assert plain(read(spark, "xml", str(tmp_path / "xml"), df.schema, rowTag="row").collect()) == [(1, "a"), (2, None)]
    write(df, "parquet", str(tmp_path / "parts"), partition_by=("k",))
    assert (tmp_path / "parts" / "k=1").is_dir() and read(spark, "parquet", str(tmp_path / "parts")).where("k = 2").count() == 1


def test_jdbc_round_trip(spark, tmp_path):
    from millrace.sources.tables import read_jdbc, write_jdbc

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    write_jdbc(spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k long, v string"), url, "t")
    got = read_jdbc(spark, url, "t", partition_by="k", bounds=(0, 20), partitions=4)
    assert got.rdd.getNumPartitions() == 4 and plain(got.collect()) == plain([(i, f"v{i}") for i in range(20)])
    with pytest.raises(ValueError):
        read_jdbc(spark, url, "t", partition_by="k")


def test_record_files(spark, tmp_path):
    from millrace.sources import lengths

    lengths.register(spark)
    df = spark.createDataFrame([(bytes([i]) * i,) for i in range(10)], "record binary").repartition(3)
    df.write.format("records").mode("append").save(str(tmp_path / "r"))
    assert sorted(bytes(r[0]) for r in spark.read.format("records").load(str(tmp_path / "r")).collect()) == [bytes([i]) * i for i in range(10)]


def test_asof_join(spark):
    from datetime import datetime, timedelta

    from millrace.operators.asof import asof_join

    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    left = spark.createDataFrame([(1, "a", t(0)), (2, "a", t(5)), (3, "a", t(100)), (4, "b", t(1)), (5, None, t(1)), (6, "a", None), (7, "a", t(5))], "id long, k string, at timestamp_ntz")
    right = spark.createDataFrame([("a", t(1), 10), ("a", t(5), 11), ("a", t(5), 9), ("a", t(30), 12), ("b", t(2), 13), (None, t(0), 14), ("a", None, 15)], "k string, seen timestamp_ntz, v long")
    got = asof_join(left, right, on=["k"], left_time="at", right_time="seen")
    assert got.columns == ["id", "k", "at", "seen", "v"]
    assert {r["id"]: r["v"] for r in got.collect()} == {1: None, 2: 11, 3: 12, 4: None, 5: None, 6: None, 7: 11}
    assert asof_join(left.limit(0), right, on=["k"], left_time="at", right_time="seen").count() == 0
    assert asof_join(left, right.limit(0), on=["k"], left_time="at", right_time="seen").where("v IS NULL").count() == 7


def test_band_join(spark):
    import random

    from millrace.operators.bands import band_join

    r = random.Random(1)
    a = [(i, r.uniform(-9, 9)) for i in range(80)] + [(100, None), (101, float("nan")), (102, float("inf"))]
    b = [(i, r.uniform(-9, 9)) for i in range(80)] + [(100, None), (101, float("nan"))]
    got = band_join(spark.createDataFrame(a, "x long, p double"), spark.createDataFrame(b, "y long, q double"), "p", "q", 0.7).select("x", "y")
    assert sorted(map(tuple, got.collect())) == sorted((i, j) for i, p in a[:80] for j, q in b[:80] if abs(p - q) <= 0.7)


def test_joins_keep_columns_of_any_name(spark):
    from datetime import datetime

    from millrace.operators.asof import asof_join
    from millrace.operators.bands import band_join

    a, b = spark.createDataFrame([(1.0, 5)], "`p.p` double, cell int"), spark.createDataFrame([(1.5, 6)], "`q.q` double, other_cell int")
    got = band_join(a, b, "p.p", "q.q", 1.0)
    assert got.columns == ["p.p", "cell", "q.q", "other_cell"] and [tuple(r) for r in got.collect()] == [(1.0, 5, 1.5, 6)]
    t = datetime(2024, 1, 1)
    got = asof_join(spark.createDataFrame([("k", t)], "`a.k` string, `t.l` timestamp"), spark.createDataFrame([("k", t, 3)], "`a.k` string, `t.r` timestamp, v int"), on=["a.k"], left_time="t.l", right_time="t.r")
    assert [tuple(r) for r in got.collect()] == [("k", t, t, 3)]


def test_join_strategies(spark):
    for name, node in (("quantities_by_priority", "SortMergeJoin"), ("lines_of_small_parts", "ShuffledHashJoin"), ("customers_by_balance_band", "BroadcastNestedLoopJoin"), ("parts_of_like_price", "HashJoin")):
        assert node in registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_estimates_are_near(spark):
    from pyspark.sql import functions as F

    from millrace.sources.tables import table

    q = registry.queries()
    exact = {r[0]: r[1] for r in table(spark, SF, "events").groupBy("event_type").agg(F.countDistinct("user_id")).collect()}
    for r in q["daily_users_merged"](spark, SF).collect():
        assert abs(r["users"] - exact[r["event_type"]]) <= 0.03 * exact[r["event_type"]] + 1
    for r in q["approximate_events"](spark, SF).collect():
        assert abs(r["users"] - exact[r["event_type"]]) <= 0.06 * exact[r["event_type"]] + 1 and len(r["quantiles"]) == 2 and len(r["frequent"]) == 5
    middle = {r[0]: r[1] for r in table(spark, SF, "lineitem").groupBy("l_returnflag").agg(F.median("l_extendedprice")).collect()}
    assert all(abs(r["middle"] / middle[r["l_returnflag"]] - 1) < 0.05 for r in q["price_sketch"](spark, SF).collect())
    by_week = table(spark, SF, "events").groupBy(F.date_trunc("week", "ts").alias("week"), "user_id").agg(F.bool_or(F.col("event_type") == "view").alias("v"), F.bool_or(F.col("event_type") == "purchase").alias("p"))
    both = {r["week"]: r["n"] for r in by_week.groupBy("week").agg(F.count_if(F.col("v") & F.col("p")).alias("n")).collect()}
    assert all(abs(r["both"] - both[r["week"]]) <= 1 for r in q["buyers_among_viewers"](spark, SF).collect())
    assert 400 < q["sampled_lines"](spark, SF).count() < 800
