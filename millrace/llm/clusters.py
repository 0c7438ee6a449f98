"""From candidate buckets to verified links, without ever listing a bucket's pairs.

Candidate generators (band hashes, shared tokens, projections) put items into buckets. An
edge from each member to its bucket's smallest member joins the buckets into clusters, with
as many edges as memberships. A cluster's payloads then meet once, in blocks of a bounded
number of items, and inside a task each pair of a block is verified in memory. What leaves a
task is linear in its items: how many links each has, and the smallest item it is linked to
inside the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, looked_up, stash, tidy

#: Items of a cluster that meet in one task at most, twice; larger clusters are split into pairs of blocks.
BLOCK = 512
#: Bytes of payloads of a block at most, but for a single larger item.
BLOCK_BYTES = 16_000_000
#: Items of small clusters that share one call.
TOGETHER = 2000


def bucket_edges(members: DataFrame, name: str) -> DataFrame:
    """members: key, id. A row (a, b) from each member of a bucket to its smallest one.

    The smallest is found by an aggregate: a bucket with a third of all rows arrives in one
    task as one row per mapper, and only buckets of more than one member are looked up.
    """
    smallest = members.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("most")).where("b < most").drop("most")
    return looked_up(members, smallest, "key", "inner", f"{name}-buckets").where("id <> b").select(F.col("id").alias("a"), "b")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root (the smallest node of its component) of every node of edges (a, b).

    Alternating large and small stars: every round links all neighbours of a node to its
    smallest one, so the number of rounds follows the logarithm of the diameter. Edges are
    kept from the larger to the smaller node; only nodes between two others, and nodes with
    several smaller neighbours, change anything, and these alone are looked up. Each round is
    written to the shared folder, so no lineage builds up.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = stash(now, f"{name}-edges")
    while True:
        below = now.select(F.col("v").alias("w")).distinct()
        low = now.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        between = stash(low.join(below, "w", "left_semi"), f"{name}-between")
        inner = between.count()
        if inner:
            large = now.join(_small(between, inner), F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
            now = stash(large, f"{name}-edges")
        several = stash(now.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")).where("m < most").drop("most"), f"{name}-several")
        many = several.count()
        if many:
            stays = F.col("m").isNull() | (F.col("v") == F.col("m"))
            both = now.join(_small(several, many), "u", "left")
            now = stash(both.select(F.when(stays, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(stays, F.col("v")).otherwise(F.col("m")).alias("v")).distinct(), f"{name}-edges")
        if not inner and not many:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indices by the links x-y."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


Verify = Callable[[dict[str, np.ndarray | list], int], Iterator[tuple[np.ndarray, np.ndarray]]]


def verified(members: DataFrame, payload: DataFrame, verify: Verify, name: str, *, block: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """Links within clusters: id, n_links, low (smallest id linked inside a block) and earlier.

    members: cluster, id (unique), n (items that id stands for) and at (array of longs that
    orders items). payload, a stored table: id (unique), bytes (their number in the other
    columns) and what verify(columns, split) looks at; it yields index pairs (x, y) of linked
    rows with x < split <= y, or with x < y among all rows if split is 0; each pair once.
    n_links counts the items linked to; earlier: one of them comes before by ``at``. An id
    may come in several rows, one from each block pair.

    Blocks hold a bounded number of items and of bytes, but for an item that is larger by
    itself. They are dealt out before the payloads join.
    """
    members = stash(members.join(payload.select("id", "bytes"), "id"), f"{name}-weighed")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("bytes").alias("heavy")).where("size > 1")
    rows = looked_up(members, sizes, "cluster", "inner", f"{name}-sizes")
    parts = F.ceil(F.greatest(F.col("size") / block, F.col("heavy") / BLOCK_BYTES)).cast("int")
    whole = members.agg(F.count("*"), F.sum("bytes")).first()
    bins = max(8, whole[0] // together, (whole[1] or 0) // BLOCK_BYTES)
    rows = rows.drop("bytes").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.join(payload.drop("bytes"), "id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    spread = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.xxhash64("cluster", "i", "j"))
    columns = [c for c in payload.columns if c not in ("id", "bytes")]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("cluster", "ascending"), ("i", "ascending"), ("j", "ascending"), ("id", "ascending")])
        key = [table[c].to_numpy() for c in ("cluster", "i", "j")]
        new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)])) if len(table) else np.zeros(0, int)
        out: list[list] = [[], [], [], []]
        for a, b in zip(new, [*new[1:], len(table)], strict=True):
            part, split = table.slice(a, b - a), 0
            own = part["own"].to_numpy()
            if key[1][a] != key[2][a]:  # two different blocks: only pairs across them
                order = np.argsort(own, kind="stable")
                part, split = part.take(pa.array(order)), int((own == own.min()).sum())
                if split == b - a:
                    continue
            ids, n = part["id"].to_numpy(), part["n"].to_numpy()
            at = np.array(part["at"].to_pylist())
            pairs = list(verify({c: part[c].combine_chunks() for c in columns}, split))
            if not pairs:
                continue
            x, y = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            links = np.bincount(x, n[y], len(ids)) + np.bincount(y, n[x], len(ids))
            rank = np.empty(len(ids), int)
            rank[np.lexsort(at.T[::-1])] = np.arange(len(ids))
            earlier = np.zeros(len(ids), bool)
            earlier[np.where(rank[x] > rank[y], x, y)] = True
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), int)
            place[order] = np.arange(len(ids))
            low = ids[order][_roots(len(ids), place[x], place[y])[place]]
            some = np.flatnonzero(links)
            for column, values in zip(out, (ids, links.astype(np.int64), low, earlier), strict=True):
                column.append(values[some])
        joined = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.int64, bool), strict=True)]
        return pa.table({"id": pa.array(joined[0], pa.int64()), "n_links": pa.array(joined[1], pa.int64()), "low": pa.array(joined[2], pa.int64()), "earlier": pa.array(joined[3], pa.bool_())})

    rows = rows.withColumn("spread", spread).select("spread", "cluster", "i", "j", "own", "id", "n", "at", *columns)
    return rows.groupBy("spread").applyInArrow(tidy(run), "id long, n_links long, low long, earlier boolean")
