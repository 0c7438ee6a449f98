"""Everything that can be reached by repeated steps, where steps may lead back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import quoted, stash, stash_path


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], *, most: int | None = None, round_col: str = "steps") -> DataFrame:
    """start's distinct rows and all that step makes of rows found, each once, with the number of steps that it first took.

    step: from the rows of the last round to their successors, of the same columns. Only rows
    that are new go into the next round, so cycles end; it stops when a round finds none, or
    after most rounds. Each round is stored in a folder by itself, which cuts the lineage and
    keeps a round once done. Nulls are values. An empty start gives no rows.
    """
    spark, columns = start.sparkSession, start.columns
    path = stash_path(spark, "fixpoint")
    schema = start.withColumn(round_col, F.lit(0)).schema
    fresh, rounds = stash(start.distinct(), "fixpoint-start"), 0
    fresh.withColumn(round_col, F.lit(0)).write.parquet(f"{path}/round=0")
    while most is None or rounds < most:
        rounds += 1
        seen = spark.read.schema(schema).parquet(*[f"{path}/round={i}" for i in range(rounds)]).alias("seen")
        same = F.lit(True)
        for c in columns:
            same &= F.col(f"new.{'`' + c.replace('`', '``') + '`'}").eqNullSafe(F.col(f"seen.{'`' + c.replace('`', '``') + '`'}"))
        step(fresh).select(*[quoted(c) for c in columns]).distinct().alias("new").join(seen, same, "left_anti").withColumn(round_col, F.lit(rounds)).write.parquet(f"{path}/round={rounds}")
        fresh = spark.read.schema(schema).parquet(f"{path}/round={rounds}").drop(round_col)
        if fresh.isEmpty():
            break
    return spark.read.schema(schema).parquet(*[f"{path}/round={i}" for i in range(rounds + 1)])
