"""Reading the tables of a data folder, and reading and writing other file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Formats that Spark reads and writes without further jars.
FORMATS = ("parquet", "orc", "json", "csv", "text", "xml")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table, a file or a folder of parts; any store that Spark can read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, fmt: str, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table in one of FORMATS. Row-wise formats should get a schema; inferring one reads the data twice."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, fmt: str, path: str, *, mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
    """Write df in one of FORMATS, in folders by the values of partition_by if given."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_jdbc(spark: SparkSession, url: str, name: str, *, partition_by: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options) -> DataFrame:
    """A database's table; with partition_by and bounds in as many ranges, each read by a task of its own.

    The ranges at both ends are open, so bounds only balance the parts. The driver's jar must be on Spark's class path.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition_by is not None:
        if bounds is None:
            raise ValueError("partition_by needs bounds")
        reader = reader.options(partitionColumn=partition_by, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, name: str, *, mode: str = "errorifexists", connections: int = 8, **options) -> None:
    """Write df to a database's table over a bounded number of connections."""
    df.coalesce(connections).write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()
