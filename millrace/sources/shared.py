"""The folder for intermediate files that driver and executors share, tables stored there, and columns by name."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of local sessions that name no folder: a temporary one for each application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a new temporary one for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        named = _local[app] = _local.get(app) or tempfile.mkdtemp(prefix="millrace-")
    return named


def stash_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it from there, which cuts its lineage."""
    path = stash_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are sent to every task at most, about 20 MB; what has more is joined by shuffles.
BROADCAST_ROWS = 500_000


def small(table: DataFrame) -> DataFrame:
    """A stored table, marked to be sent to every task if counting finds it small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def fresh(df: DataFrame, name: str) -> str:
    """A column name like that one which df doesn't have, in any case of its letters."""
    return unused(name, df)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like that one which none of the frames has, in any case of its letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """A column by its name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")
