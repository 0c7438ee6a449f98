"""A stream over files that are there, run to its end, and what it has written as a table."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stash, stash_path, unused


@contextlib.contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with these settings, and with its own ones afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows of a trigger for each of its files, which are written and read by a task each; and files of a trigger at most.
FILE_ROWS, MOST_FILES = 100_000, 64


def in_files(df: DataFrame, order: str, files: int, name: str) -> DataFrame:
    """df as a stream of so many triggers, one after another by ranges of order."""
    part, rows = unused("part", df), df.count()
    each = max(1, min(MOST_FILES, rows // (files * FILE_ROWS)))  # ranges of a trigger
    ranged = df.repartitionByRange(files * each, order).withColumn(part, F.floor(F.spark_partition_id() / each).cast("int"))
    return in_triggers(stash(ranged, name), part, files, name)


def in_triggers(df: DataFrame, part: str, triggers: int, name: str) -> DataFrame:
    """df as a stream whose trigger i, from 0, takes the rows with that number in part, which is dropped.

    Streams take files by their times and so many a trigger, so each trigger's are written
    after those of the one before, and all have as many: by the largest one's rows, with
    empty ones where rows don't fill them. Rows are counted first.
    """
    spark, path, rows = df.sparkSession, stash_path(df.sparkSession, name), df.drop(part)
    largest = df.where(F.col(part).between(0, triggers - 1)).groupBy(part).count().agg(F.max("count")).first()[0] or 0
    files, written = max(1, min(MOST_FILES, -(-largest // FILE_ROWS))), 0
    for i in range(triggers):
        of = df.where(F.col(part) == i).drop(part)
        (of.repartition(files) if files > 1 else of.coalesce(1)).write.mode("append").parquet(path)
        written += files
        for _ in range(written - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def streamed(spark: SparkSession, folder: str, name: str, *, files: int | None = None) -> DataFrame:
    """One of the folder's tables as a stream; files: how many a trigger takes at most."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # a plain path must be a folder for a stream; a pattern may be a file as well
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{folder}/{name}.parque[t]")


def finished(df: DataFrame, name: str, *, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """What the stream df has emitted once it has taken every file, read from the shared folder.

    append: the rows whose time has passed; what the watermark holds back stays out.
    complete: the last trigger's result. update: of each of ``keys`` (the grouping's columns;
    null is a value) the row that came last. A trigger that runs again after a failure
    writes the same files again.
    """
    spark, path = df.sparkSession, stash_path(df.sparkSession, name)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{path}/rows")
    else:

        def put(rows: DataFrame, trigger: int) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/rows/trigger={trigger}" if mode == "update" else f"{path}/rows")

        query = writer.foreachBatch(put).start()
    query.awaitTermination()
    if mode != "update":
        return spark.read.schema(df.schema).parquet(f"{path}/rows")
    others = [c for c in df.columns if c not in keys]
    came = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("trigger", T.LongType())])).parquet(f"{path}/rows")
    last = came.groupBy(*keys).agg(F.max_by(F.struct(*others), "trigger").alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col("last")[c].alias(c) for c in df.columns])
