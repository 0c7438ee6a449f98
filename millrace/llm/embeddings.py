"""Near-duplicate vectors by p-stable hashing for Euclidean distance, then exact cosines.

Vectors are normalised, so a cosine of c is a distance of sqrt(2 - 2c). A table's hash is k
random projections quantised to steps of ``width``; two vectors share it with a known
probability that falls with their distance. k grows with the number of vectors so that
unrelated ones seldom meet, and the number of tables follows from the recall wanted at the
threshold itself. Every pair that meets is decided by its exact double-precision cosine.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import bucket_edges, components, verified
from .common import id_of, looked_up, mix, quoted, stash, tidy

THRESHOLD, RECALL, WIDTH = 0.95, 0.99, 2.0


def meet(distance: float, width: float) -> float:
    """Probability that one quantised projection agrees for two points at a distance."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """(projections per table, tables): under 0.3 chance meetings of orthogonal vectors each, and the recall at the threshold."""
    near, far = meet(math.sqrt(2 - 2 * threshold), width), meet(math.sqrt(2), width)
    for k in range(4, 200):
        tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))
        if vectors * tables * far**k < 0.3:
            break
    return k, tables


def _matrix(column: pa.Array, dim: int | None = None) -> tuple[list[int], np.ndarray]:
    """Indices and values of the vectors that have a direction: not null or zero, all components finite."""
    rows, keep = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                rows.append(x)
                keep.append(i)
    return keep, rows


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row, linking cosines of at least threshold.

    Vectors that are null, zero, empty or hold null or non-finite components link with
    nothing, nor do rows whose id is null (component_id is null) or vectors of different
    lengths. Equal vectors are one class during the search and count as links of each
    other. n_links counts rows, and component_id is the smallest id of the rows reachable, so
    rows that share an id are vectors of their own: each has its own links. An empty table
    gives no rows. Other columns are not read.
    """
    rows = vectors.select(id_of(vectors, id_col).alias("vec_id"), quoted(vector_col).cast("array<double>").alias("v"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, found = _matrix(b.column(1))
            ids = b.column(0).to_pylist()
            digest: list[list] = [[None] * len(ids), [None] * len(ids)]
            raw: list[bytes | None] = [None] * len(ids)
            for i, x in zip(keep, found, strict=True):
                if ids[i] is not None:
                    raw[i] = (x + 0.0).tobytes()
                    digest[0][i], digest[1][i] = struct.unpack("<qq", hashlib.blake2b(raw[i], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(d, pa.int64()) for d in digest], pa.array(raw, pa.binary())], names=["vec_id", "copy", "copy2", "v"])

    own = stash(rows.mapInArrow(tidy(read), "vec_id long, copy long, copy2 long, v binary"), "vectors")
    # equal vectors are found by 128 bits; a class's number is written down with it and stays the same
    classes = own.where("copy IS NOT NULL").groupBy("copy", "copy2").agg(F.first("v").alias("v"), F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = stash(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    k, tables = plan_tables(classes.count(), threshold, recall)

    def planes(d: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for a length of vector in every task."""
        rng = np.random.Generator(np.random.PCG64(d))
        return rng.standard_normal((d, k * tables)), rng.uniform(0, WIDTH, k * tables)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = lru_cache(16)(planes)  # so many lengths' planes are held at a time
        for b in batches:
            for at in range(0, len(b), 512):
                ids, raw = b.column(0).slice(at, 512).to_numpy(), b.column(1).slice(at, 512).to_pylist()
                for d in {len(v) // 8 for v in raw}:
                    some = [i for i, v in enumerate(raw) if len(v) == 8 * d]
                    x = np.frombuffer(b"".join(raw[i] for i in some)).reshape(len(some), d)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    a, shift = met(d)
                    cell = np.floor((x @ a + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(some), tables, k)
                    h = np.broadcast_to(np.arange(tables, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(d), (len(some), tables))
                    for c in range(k):
                        h = mix(h ^ cell[:, :, c]) + np.uint64(c)
                    yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(ids[some], tables))], names=["key", "id"])

    members = classes.select("id", "v").mapInArrow(tidy(buckets), "key long, id long")
    clusters = components(bucket_edges(stash(members, "buckets"), "vector"), "vectors").select(F.col("node").alias("id"), F.col("root").alias("cluster"))

    def verify(columns: dict, split: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        raw = columns["v"].to_pylist()
        size = np.array([len(v) for v in raw])
        for d in set(size.tolist()):
            some = np.flatnonzero(size == d)
            x = np.frombuffer(b"".join(raw[i] for i in some)).reshape(len(some), d // 8)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            cosine = x @ x.T
            i, j = np.nonzero(np.triu(cosine >= threshold - 1e-9, 1))
            close = np.abs(cosine[i, j] - threshold) < 1e-9  # decided by a sum that doesn't depend on the blocks
            ok = ~close
            for p in np.flatnonzero(close):
                ok[p] = math.fsum(x[i[p]] * x[j[p]]) >= threshold
            i, j = some[i[ok]], some[j[ok]]
            if split:
                i, j = np.minimum(i, j), np.maximum(i, j)
                across = (i < split) & (j >= split)
                i, j = i[across], j[across]
            yield i, j

    found = verified(clusters.join(classes.select("id", "n", F.array("id").alias("at")), "id"), classes.select("id", "v", F.octet_length("v").alias("bytes")), verify, "vector")
    found = stash(found, "vector-links")
    counts = found.groupBy("id").agg(F.sum("n_links").alias("linked"))
    roots = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")), "vector-links")
    facts = classes.select("id", "copy", "copy2", "first", "n").join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").where("n > 1 OR linked > 0")
    facts = stash(facts.select("copy", "copy2", "first", F.coalesce("root", "id").alias("root"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vector-facts")
    smallest = facts.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = looked_up(facts, smallest, "root", "inner", "vector-roots").select("copy", "copy2", "n_links", "component_id")
    out = looked_up(own.select("vec_id", "copy", "copy2"), facts, ["copy", "copy2"], "left", "vector-found")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
