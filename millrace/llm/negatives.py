"""Hard negatives by a full sort of every anchor's integer scores.

The anchors are a stated set of queries against all rows. Both are dealt into blocks, and
each block of anchors meets each block of rows in a task of its own, twice. First a task
sorts an anchor's rows of the same label by score and id and gives back the first few; over
all blocks, these are the anchor's positives. Then it sorts the rows of other labels, finds
by binary search where each positive's upper limit lies, and reads the first k rows from
there that reach the lower limit; the best k over all blocks are the answer. So no task holds
more than two blocks, and what leaves it grows with the anchors and not with the rows.

Scores are sums of products of whole numbers. They are added in doubles where all sums in a
block are below 2^53, so exactly; else as Python's integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, quoted, stash, tidy

#: Rows of a block: at least, and at most. Between, about ROW_BLOCKS blocks hold all rows.
LEAST, MOST, ROW_BLOCKS = 1024, 32_768, 64
ANCHORS = 2048
#: Scores that a task holds at a time, beside the block's vectors.
TOGETHER = 2_000_000
EXACT = 2.0**53


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors, exactly, as 64-bit integers; OverflowError where one doesn't fit."""
    if not anchors.shape[1]:
        return np.zeros((len(anchors), len(rows)), np.int64)
    if np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * anchors.shape[1] < EXACT:
        return (anchors @ rows.T).astype(np.int64)
    whole = [[int(x) for x in v] for v in rows.tolist()]
    return np.array([[sum(x * y for x, y in zip(a, v, strict=True)) for v in whole] for a in ([int(x) for x in v] for v in anchors.tolist())], dtype=np.int64).reshape(len(anchors), len(rows))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw)).reshape(len(raw), -1) if raw[0] else np.zeros((len(raw), 0))


def _in_blocks(anchors: DataFrame, rows: DataFrame, find, name: str, given: list[str], schema: str) -> DataFrame:
    """Each anchor block with each row block of the same length of vectors; find sees one pair of tables.

    Anchors come with their block and with given columns, rows with theirs; both with dim. The
    numbers of blocks follow from counts by length of vector.
    """
    n_rows = rows.groupBy("dim").agg(F.max("block").alias("rows_to"))
    n_anchors = anchors.groupBy("dim").agg(F.max("block").alias("anchors_to"))
    counts = F.broadcast(stash(n_rows.join(n_anchors, "dim"), f"{name}-blocks"))  # a row per length of vector that anchors have
    left = anchors.join(counts, "dim").select("dim", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), "rows_to")).alias("j"), "a", "vec_id", "label", "v", *given)
    right = rows.join(counts, "dim").select("dim", F.explode(F.sequence(F.lit(0), "anchors_to")).alias("i"), F.col("block").alias("j"), "vec_id", "label", "v")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks()
        if not len(a) or not len(b):
            return find(a.slice(0, 0), b, None)
        x, y = _vectors(a["v"]), _vectors(b["v"])
        step = max(1, TOGETHER // len(b))
        return pa.concat_tables([find(a.slice(at, step), b, scores(x[at : at + step], y)) for at in range(0, len(a), step)])

    right = right.toDF(*right.columns)  # both come from one table, whose columns Spark couldn't tell apart
    return left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInArrow(tidy(run), schema)


def _table(columns: list[list], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def hard_negatives(vectors: DataFrame, anchor: Column, *, id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding", positives: int = 5, k: int = 5, lower: tuple[int, int] = (80, 100), scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: a condition on vectors' columns. label: a column or its name, of whole numbers.
    Components become floor(scale * x). An anchor's positives are its first rows of the same
    label by score, then smaller id; a positive's negatives are the first k rows of other
    labels with lower[0] * positive <= lower[1] * negative and negative <= positive, in the
    same order. Fewer are given where there aren't as many.

    Rows with a null id, label, vector or component, or one that isn't finite, take no part;
    vectors of other lengths than the anchor's aren't compared with it, and empty ones score
    0. An anchor's own id is none of its positives; rows that share an id are rows of their
    own, and each anchor among them has its own results. Ties in score and id go by label.
    Very long vectors are compared like others; a score beyond 64 bits is an error. An empty
    table gives no rows. Other columns are not read.
    """
    label = quoted(label) if isinstance(label, str) else label
    rows = vectors.select(id_of(vectors, id_col).alias("vec_id"), label.cast("long").alias("label"), quoted(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(sound)

    def whole(batches):
        for b in batches:
            v = [np.floor(scale * np.array(x, np.float64)) for x in b.column("v").to_pylist()]
            if any(not np.isfinite(x).all() for x in v):
                raise OverflowError("a component is beyond the range of doubles when scaled")
            columns = [b.column(c) for c in ("vec_id", "label", "anchor")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in v], pa.int32()), pa.array([(x + 0.0).tobytes() for x in v], pa.binary())], names=["vec_id", "label", "anchor", "dim", "v"])

    rows = rows.mapInArrow(tidy(whole), "vec_id long, label long, anchor boolean, dim int, v binary")
    rows = stash(rows.withColumn("a", F.monotonically_increasing_id()), "negatives-rows")
    n, asked = rows.agg(F.count("*"), F.count_if("anchor")).first()
    blocks = max(1, -(-n // min(MOST, max(LEAST, n // ROW_BLOCKS))))
    shares = max(1, -(-(asked or 0) // ANCHORS))
    own = rows.where("anchor").select("dim", F.pmod(F.xxhash64("a"), F.lit(shares)).cast("int").alias("block"), "a", "vec_id", "label", "v")
    all_rows = rows.select("dim", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "label", "v")

    found = [("a", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("label", pa.int64())]

    def same_label(a: pa.Table, b: pa.Table, score: np.ndarray | None) -> pa.Table:
        out: list[list] = [[], [], [], []]
        ids, labels = b["vec_id"].to_numpy(), b["label"].to_numpy()
        for i, (at, me, mine) in enumerate(zip(*(a[c].to_pylist() for c in ("a", "vec_id", "label")), strict=True)):
            other = np.flatnonzero((labels == mine) & (ids != me))
            best = other[np.lexsort((ids[other], -score[i][other]))[:positives]]
            for column, x in zip(out, (np.full(len(best), at), ids[best], score[i][best], labels[best]), strict=True):
                column.append(x)
        return _table(out, found)

    first = _in_blocks(own, all_rows, same_label, "negatives-positives", [], "a long, id long, score long, label long")
    order = [F.desc("score"), F.asc("id"), F.asc("label")]
    first = first.withColumn("p", F.row_number().over(Window.partitionBy("a").orderBy(*order))).where(F.col("p") <= positives)
    first = first.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("p", "id", "score"))).alias("best"))  # `positives` rows a group
    first = first.select("a", F.col("best.id").alias("p_id"), F.col("best.score").alias("p_score"))
    own = stash(own.join(first, "a"), "negatives-anchors")

    taken = [("a", pa.int64()), ("anchor_id", pa.int64()), ("p", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("label", pa.int64())]

    def between(a: pa.Table, b: pa.Table, score: np.ndarray | None) -> pa.Table:
        out: list[list] = [[] for _ in taken]
        ids, labels = b["vec_id"].to_numpy(), b["label"].to_numpy()
        for i, (at, me, mine, p_ids, p_scores) in enumerate(zip(*(a[c].to_pylist() for c in ("a", "vec_id", "label", "p_id", "p_score")), strict=True)):
            other = np.flatnonzero(labels != mine)
            other = other[np.lexsort((labels[other], ids[other], -score[i][other]))]
            falling = score[i][other]
            starts = np.searchsorted(-falling, [-s for s in p_scores])
            for p, (start, p_id, p_score) in enumerate(zip(starts, p_ids, p_scores, strict=True)):
                best = [j for j in range(start, min(start + k, len(other))) if lower[0] * p_score <= lower[1] * int(falling[j])]
                m, best = len(best), other[best]
                for column, x in zip(out, (np.full(m, at), np.full(m, me), np.full(m, p), np.full(m, p_id), np.full(m, p_score), ids[best], score[i][best], labels[best]), strict=True):
                    column.append(x)
        return _table(out, taken)

    pairs = _in_blocks(own, all_rows, between, "negatives", ["p_id", "p_score"], "a long, anchor_id long, p int, positive_id long, positive_score long, id long, score long, label long")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a", "p").orderBy(*order))).where(F.col("rank") <= k)
    return pairs.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
