"""Running values over ordered rows, whatever the share of the rows that one key has.

A window puts all rows of a key in one task. Here the rows are dealt out by ranges of
(key, order), so a key with many rows lies in many parts. Each part scans its own rows; a
part can continue only the key that it begins with, so what the parts carry to each other is
at most one row a part, combined by an associative operation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import fresh, quoted, stash

#: How a part's total and the value within the next part make the value over both.
COMBINE = {
    "sum": lambda before, own: F.coalesce(before + own, before, own),
    "count": lambda before, own: F.coalesce(before, F.lit(0)) + own,
    "min": lambda before, own: F.least(before, own),
    "max": lambda before, own: F.greatest(before, own),
}
WITHIN = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Lag:
    """The value of the row that many rows before, of the same key; null where there is none."""

    value: Column | str
    offset: int = 1


@dataclass(frozen=True)
class Running:
    """sum, count, min or max of the key's rows up to this one, as ROWS UNBOUNDED PRECEDING has it."""

    op: str
    value: Column | str


def scan(df: DataFrame, by: list[str], order: list[str | Column], outputs: dict[str, Lag | Running], *, parts: int | None = None) -> DataFrame:
    """df and one column per output, whose name replaces a column of df of the same name.

    by: names of the key's columns, none for all rows as one key; null is a key. order: names
    or columns with their direction; nulls go where Spark's direction puts them. Rows that are
    equal in key and order follow each other in some order, the same for all outputs, so
    results over them repeat only if order tells all rows apart. An empty table gives no rows.
    Doubles are added part by part, so their last digits differ from a sum in one go.

    Rows are shuffled twice, by range and by part, and stored once; parts (a task's share,
    four a shuffle partition unless said) only bounds how much meets in one task.
    """
    spark = df.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, place, tie = (fresh(df, n) for n in ("part", "place", "tie"))
    key = [quoted(k) for k in by]
    along = [quoted(o) if isinstance(o, str) else o for o in order]
    values = {fresh(df, f"value{i}"): out.value for i, out in enumerate(outputs.values())}
    rows = df.select("*", *[(quoted(v) if isinstance(v, str) else v).alias(n) for n, v in values.items()])
    rows = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *key, *along, F.col(tie)).withColumn(part, F.spark_partition_id())
    group = Window.partitionBy(part, *key).orderBy(*along, tie)
    upto = group.rowsBetween(Window.unboundedPreceding, 0)
    own = {fresh(df, f"own{i}"): (F.lag(v, out.offset).over(group) if isinstance(out, Lag) else WITHIN[out.op](v).over(upto)) for i, (out, v) in enumerate(zip(outputs.values(), map(F.col, values), strict=True))}
    # of a lag, the last values so far, as many as the next part may look back
    tails = {fresh(df, f"tail{i}"): F.array(*[F.lag(v, k).over(group) for k in reversed(range(1, out.offset))], F.col(v)) for i, (out, v) in enumerate(zip(outputs.values(), values, strict=True)) if isinstance(out, Lag)}
    rows = stash(rows.withColumns(own | tails | {place: F.row_number().over(group)}).drop(tie), "scan")

    # each part's last value of a key, and what all parts before it come to
    of, rank = fresh(df, "part_of"), fresh(df, "rank")
    befores = [fresh(df, f"before{i}") for i in range(len(own))]
    tail = iter(tails)
    last = [F.slice(F.max_by(next(tail), place), -F.least(F.lit(out.offset), F.max(place)), out.offset).alias(o) if isinstance(out, Lag) else F.max_by(o, place).alias(o) for out, o in zip(outputs.values(), own, strict=True)]
    totals = rows.groupBy(part, *key).agg(*last)
    before = Window.partitionBy(*key or [F.lit(0)]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = {}
    for out, o, b in zip(outputs.values(), own, befores, strict=True):
        carried[b] = F.flatten(F.collect_list(o).over(before)) if isinstance(out, Lag) else WITHIN["sum" if out.op == "count" else out.op](o).over(before)
    carries = totals.withColumns(carried | {rank: F.row_number().over(Window.partitionBy(*key or [F.lit(0)]).orderBy(part))}).where(F.col(rank) > 1)
    names = [fresh(df, f"key{i}") for i in range(len(by))]
    carries = carries.select(F.col(part).alias(of), *[k.alias(n) for k, n in zip(key, names, strict=True)], *carried)
    same = F.col(part) == F.col(of)
    for k, n in zip(key, names, strict=True):
        same &= k.eqNullSafe(F.col(n))
    rows = rows.join(F.broadcast(carries), same, "left")  # a row a part at most
    found = {}
    for (name, out), o, b in zip(outputs.items(), own, map(F.col, befores), strict=True):
        found[name] = F.when(F.col(place) <= out.offset, F.try_element_at(b, F.col(place) - out.offset - 1)).otherwise(F.col(o)) if isinstance(out, Lag) else COMBINE[out.op](b, F.col(o))
    kept = [quoted(c) for c in df.columns if c.lower() not in {n.lower() for n in found}]
    return rows.select(*kept, *[v.alias(n) for n, v in found.items()])
