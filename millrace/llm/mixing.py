"""Mixing sources to target weights by hash thresholds.

Every row has a 64-bit hash; a source's last, partial copy takes the rows whose hash is at
most a threshold. The threshold comes from histograms of words by (source, hash digit): the
digit in which the running sum passes the budget is refined by the next 12 bits, for that
digit's rows alone. Nothing is sorted and the driver holds one row per source, never per
document. The histograms are nested, so a larger budget takes a superset of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few_rows, fresh, quoted, stash, word_count

#: Bits of the hash that one histogram resolves; five levels use up a 60-bit hash.
DIGIT_BITS, LEVELS = 12, 5
#: Sources up to which their targets are sent to every task; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Shares of share * sum(sizes) by weight, none above most times its size.

    What a stopped target leaves is shared again by weight. That has one solution,
    min(most * size, weight * level), whose level is found by stopping the sources in the
    order in which they reach their limits.
    """
    left, weight = share * sum(sizes), float(sum(weights))
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    for n, i in enumerate(order):
        if most * sizes[i] * weight <= weights[i] * left:
            out[i] = float(most * sizes[i])
            left, weight = left - out[i], weight - weights[i]
        else:
            for j in order[n:]:
                out[j] = left * weights[j] / weight
            break
    return out


def _digit(level: int) -> Column:
    return F.shiftright("h", DIGIT_BITS * (LEVELS - 1 - level)).bitwiseAND((1 << DIGIT_BITS) - 1)


def _row_hash(doc_id: str, text: str) -> Column:
    """60 bits that no other column decides, so that copies of a text differ by their ids."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(17), quoted(doc_id), quoted(text)), 64 - DIGIT_BITS * LEVELS)


def _thresholds(rows: DataFrame, need: dict[str | None, float]) -> dict[str | None, tuple[int, int | None, float]]:
    """For each source: (below, tied, short). Rows whose hash is less than below have together at most the words needed.

    rows: source, size, h. The next row would have more; it is counted as below if that is
    nearer. If more than one row has the next hash, tied is that hash and short what is
    missing without these rows; otherwise tied is None.
    """
    spark = rows.sparkSession
    schema = pa.schema([("source", pa.string()), ("low", pa.int64()), ("need", pa.float64())])
    out: dict[str | None, tuple[int, int | None, float]] = {}
    seek = {s: (0, n) for s, n in need.items() if n > 0}
    for level in range(LEVELS):
        if not seek:
            break
        low = few_rows(spark, [(s, a, n) for s, (a, n) in seek.items()], schema)
        low = F.broadcast(low) if len(seek) <= BROADCAST_SOURCES else low
        near = rows.alias("r").join(low.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.shiftright("h", DIGIT_BITS * (LEVELS - level)) == F.col("low")))
        digits = near.groupBy(F.col("r.source").alias("source"), _digit(level).alias("digit"), "low", "need").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        edge = digits.withColumn("upto", upto).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("words") < F.col("need")))
        seek, step = {}, DIGIT_BITS * (LEVELS - 1 - level)
        for r in edge.collect():
            short, base = r["need"] - (r["upto"] - r["words"]), (r["low"] << DIGIT_BITS) + r["digit"]
            if r["n"] == 1:  # in or out, whichever is nearer
                out[r["source"]] = ((base + (2 * short >= r["words"])) << step, None, 0.0)
            elif level < LEVELS - 1:
                seek[r["source"]] = (base, short)
            else:
                out[r["source"]] = (base, base, short)
    return out


def _planned(docs: DataFrame, weights: Sequence[float], share: float, most: float, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with further columns, whose names are given: size, source_size, target and copies.

    The driver holds a row per source. Rows that differ in nothing that is hashed, at a
    source's threshold, are stored with a place each, whose hash then parts them as the others.
    """
    spark = docs.sparkSession
    name = {c: fresh(docs, f"_{c}") for c in ("size", "h", "key", "source_size", "target", "whole", "below", "tied", "copies", "place", "source")}
    source = quoted(source_col).cast("string")
    sized = docs.withColumns({name["size"]: word_count(quoted(text_col).cast("string")), name["h"]: _row_hash(id_col, text_col), name["key"]: source})
    rows = stash(sized.select(F.col(name["key"]).alias("source"), F.col(name["size"]).alias("size"), F.col(name["h"]).alias("h")), "mix")
    found = sorted(rows.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] or 0 for r in found]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most) if found else []
    whole = {r["source"]: int(aim // size) if size else 0 for r, size, aim in zip(found, sizes, aims, strict=True)}
    cuts = _thresholds(rows, {r["source"]: aim - whole[r["source"]] * size for r, size, aim in zip(found, sizes, aims, strict=True)})
    schema = pa.schema([(name["source"], pa.string()), *[(name[c], k) for c, k in (("source_size", pa.int64()), ("target", pa.float64()), ("whole", pa.int64()), ("below", pa.int64()), ("tied", pa.int64()))]])

    def plan(of: list) -> DataFrame:
        made = few_rows(spark, of, schema)
        return F.broadcast(made) if len(of) <= BROADCAST_SOURCES else made

    facts = [(r["source"], size, aim, whole[r["source"]], *cuts.get(r["source"], (0, None, 0.0))[:2]) for r, size, aim in zip(found, sizes, aims, strict=True)]
    out = sized.join(plan(facts), F.col(name["key"]).eqNullSafe(F.col(name["source"])))
    extra = (F.col(name["h"]) < F.col(name["below"])).cast("long")
    ties = {s: c[2] for s, c in cuts.items() if c[1] is not None}
    if not ties:
        return out.withColumn(name["copies"], F.col(name["whole"]) + extra), name
    same = F.coalesce(F.col(name["h"]) == F.col(name["tied"]), F.lit(False))
    tied = stash(out.where(same).withColumn(name["place"], F.monotonically_increasing_id()), "mix-ties")
    own = F.shiftrightunsigned(F.xxhash64(F.lit(17), F.col(name["place"])), 64 - DIGIT_BITS * LEVELS)
    inner = _thresholds(tied.select(F.col(name["key"]).alias("source"), F.col(name["size"]).alias("size"), own.alias("h")), ties)
    part = fresh(tied, "_part")
    again = few_rows(spark, [(s, inner.get(s, (0, None, 0.0))[0]) for s in ties], pa.schema([(part, pa.string()), (f"{part}below", pa.int64())]))
    tied = tied.join(F.broadcast(again) if len(ties) <= BROADCAST_SOURCES else again, F.col(name["key"]).eqNullSafe(F.col(part)))
    tied = tied.withColumn(name["copies"], F.col(name["whole"]) + (own < F.col(f"{part}below")).cast("long")).drop(part, f"{part}below", name["place"])
    return out.where(~same).withColumn(name["copies"], F.col(name["whole"]) + extra).unionByName(tied), name


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), *, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document: doc_id, text, source, size, source_size, target, copies, taken.

    Sources in code point order, null last, take weights in turn. Together they share
    share * (all words); no source is taken more than most times. copies * size = taken, and a
    source's taken words differ from its target by half its largest document at most.

    A null text has size 0; a null source is a source of its own; a null id is hashed like
    any other value. Of rows with the same id and text at a source's threshold as many are
    taken as come nearest; which of them is left open. A source without words has target 0. An
    empty table gives no rows. Texts of any length count whole. Other columns of docs are not
    read, so their names don't matter.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"), quoted(source_col).cast("string").alias("source"))
    out, name = _planned(rows, weights, share, most, "doc_id", "text", "source")
    own = [F.col(name[c]).alias(c) for c in ("size", "source_size", "target", "copies")]
    return out.select("doc_id", "text", "source", *own, (F.col(name["copies"]) * F.col(name["size"])).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), *, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: docs' rows and columns, each row as often as mix_sources takes it. Columns may have any names."""
    out, name = _planned(docs, weights, share, most, id_col, text_col, source_col)
    times = F.col(name["copies"]).cast("int")
    out = out.where(times > 0).withColumn(name["place"], F.explode(F.sequence(F.lit(1), times)))
    return out.select(*[quoted(c) for c in docs.columns])
