"""Overlap join of two large sides of intervals, by cells of several sizes.

Cells of one size suit intervals of one length: long ones would enter very many of them, and
short ones would meet too many others. Here an interval lives on the level whose cells are
just longer than itself, so it lies in two of them at most, and looks for others on its own
and on all coarser levels that the other side lives on. Two intervals that overlap meet on
the coarser of their two levels, in the cell in which their common part begins, so exactly
once; all of it is an equi-join. Where rows have keys as well, cells are only for keys that
many rows of both sides have; the others' rows meet by the key alone, each moved once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import quoted, small, stash, unused

#: Numbers of ticks from here on count as one, so that all sums fit in 64 bits; they still compare by their own values.
FAR = 2**60

#: Rows of a key that all those of the other side are compared with; a key with more on both sides goes by cells.
FEW = 1_000


def ticks(df: DataFrame, column: str, unit: float) -> Column:
    """A whole number that never falls as the column rises: days, microseconds, or multiples of unit."""
    kind, c = df.select(quoted(column)).schema[0].dataType, quoted(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return F.floor(F.greatest(F.lit(-float(FAR)), F.least(F.lit(float(FAR)), c.cast("double") / unit))).cast("long")


def _sound(df: DataFrame, at: tuple[str, str], closed: bool) -> DataFrame:
    """df's rows whose interval holds something."""
    begin, end = quoted(at[0]), quoted(at[1])
    sound = (begin <= end) if closed else (begin < end)
    for c, name in ((begin, at[0]), (end, at[1])):
        if isinstance(df.select(quoted(name)).schema[0].dataType, (T.FloatType, T.DoubleType)):
            sound &= ~F.isnan(c)
    return df.where(sound)


def _spans(df: DataFrame, at: tuple[str, str], closed: bool, unit: float, names: dict[str, str]) -> DataFrame:
    """Those rows with their interval's first and last tick and its level."""
    low, high = (ticks(df, name, unit) for name in at)
    rows = _sound(df, at, closed).withColumns({names["low"]: low, names["high"]: high})
    return rows.withColumn(names["level"], F.ceil(F.log2((F.col(names["high"]) - F.col(names["low"])).cast("double") + 1)).cast("int"))


def _levels(df: DataFrame, level: str) -> list[int]:
    return sorted(r[0] for r in df.select(level).distinct().collect())  # 62 at most


def _many(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], few: int) -> DataFrame | None:
    """The keys, in columns k0, k1 and so on, that more than few rows of both sides have; None if there are none."""
    counted = lambda df, at: df.select(*[quoted(p[at]).alias(f"k{i}") for i, p in enumerate(on)]).dropna().groupBy(*[f"k{i}" for i in range(len(on))]).count().where(F.col("count") > few).drop("count")
    keys = stash(counted(left, 0), "left-keys")
    if keys.isEmpty():
        return None
    keys = stash(keys.join(counted(right, 1), [f"k{i}" for i in range(len(on))], "left_semi"), "both-keys")
    return None if keys.isEmpty() else small(keys)


def overlap_join(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], *, on: list[tuple[str, str]] | None = None, closed: bool = True, unit: float = 1.0, few: int = FEW) -> DataFrame:
    """Pairs whose intervals have a point in common, with both sides' columns.

    left_at, right_at: names of the begin and the end; numbers, dates or timestamps, of like
    kinds. on: pairs of names that must be equal too. closed: both ends belong to an
    interval; else its end doesn't. unit: for numbers that aren't whole, a length that is
    short beside most intervals; results don't depend on it. Infinite ends are allowed.

    A null bound, NaN, and an interval that ends before it begins match nothing, nor do null
    keys; one that begins where it ends is a point if closed and empty if not. Repeated rows
    pair each time. The sides' columns must have different names.

    few: with on, keys that more rows of both sides have go by cells, and all rows do without
    on. Rows of other keys are shuffled once; keys are counted first, which reads the left
    side, and the right side if a left key has more. By cells, both sides are read several
    times (levels first), and each row is shuffled twice a level of the other side at most; a
    cell with very many rows is split by Spark as a skewed key.
    """
    if {c.lower() for c in left.columns} & {c.lower() for c in right.columns}:
        raise ValueError("the sides' columns must have different names")
    if not on:
        return _by_cells(left, right, left_at, right_at, [], closed, unit)
    many = _many(left, right, on, few)
    of = lambda df, at, how: df.join(many, [quoted(p[at]) == many[f"k{i}"] for i, p in enumerate(on)], how)
    l_few, r_few = (left, right) if many is None else (of(left, 0, "left_anti"), of(right, 1, "left_anti"))
    meet = _meet(left_at, right_at, closed)
    for a, b in on:
        meet &= quoted(a) == quoted(b)
    found = _sound(l_few, left_at, closed).join(_sound(r_few, right_at, closed), meet)
    if many is not None:
        found = found.unionByName(_by_cells(of(left, 0, "left_semi"), of(right, 1, "left_semi"), left_at, right_at, on, closed, unit))
    return found.select(*[quoted(c) for c in (*left.columns, *right.columns)])


def _meet(left_at: tuple[str, str], right_at: tuple[str, str], closed: bool) -> Column:
    (lb, le), (rb, re) = ((quoted(x) for x in at) for at in (left_at, right_at))
    return (lb <= re) & (rb <= le) if closed else (lb < re) & (rb < le)


def _by_cells(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], on: list[tuple[str, str]], closed: bool, unit: float) -> DataFrame:
    new = ("low", "high", "level", "cell", "on_level")
    names, others = ({n: unused(f"{side}_{n}", left, right) for n in new} for side in ("left", "right"))
    l_rows, r_rows = _spans(left, left_at, closed, unit, names), _spans(right, right_at, closed, unit, others)
    l_levels, r_levels = _levels(l_rows, names["level"]), _levels(r_rows, others["level"])

    def entered(rows: DataFrame, n: dict[str, str], levels: list[int], own: bool) -> DataFrame:
        """A row per cell: on its own level, or on those levels of the other side that are coarser (own: or as coarse)."""
        here = F.array(F.col(n["level"])) if own else F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x > F.col(n["level"]))
        rows = rows.withColumn(n["on_level"], F.explode(here))
        shifted = lambda c: F.call_function("shiftright", F.col(c), F.col(n["on_level"]))
        return rows.withColumn(n["cell"], F.explode(F.sequence(shifted(n["low"]), shifted(n["high"]))))

    meet = (F.col(names["on_level"]) == F.col(others["on_level"])) & (F.col(names["cell"]) == F.col(others["cell"]))
    for a, b in on:
        meet &= quoted(a) == quoted(b)
    begins = F.greatest(names["low"], others["low"])
    meet &= F.call_function("shiftright", begins, F.col(names["on_level"])) == F.col(names["cell"])
    meet &= _meet(left_at, right_at, closed)
    # left ones that are as long or longer, against right ones on all levels from their own on; and the other way round
    r_all = entered(r_rows, others, l_levels, False).unionByName(entered(r_rows, others, [], True))
    found = entered(l_rows, names, [], True).join(r_all, meet)
    found = found.unionByName(entered(l_rows, names, r_levels, False).join(entered(r_rows, others, [], True), meet))
    return found.select(*[quoted(c) for c in (*left.columns, *right.columns)])
