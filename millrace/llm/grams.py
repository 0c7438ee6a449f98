"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

A document's set holds the 64-bit hashes of its five-word shingles; one with fewer words has
one shingle of them all. Documents with equal sets are one class from the start, so a large
group of copies is one item. Bands of MinHash rows make candidate buckets; rows and bands
follow from the recall wanted at the threshold. Candidate classes form clusters, whose sets
meet in blocks where each pair's Jaccard similarity is computed in full.

Only classes with a candidate move their sets: a bitmap of a fixed size says which documents
may be among them, so the others' texts and sets never leave their tasks.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clusters import bucket_edges, components, verified
from .common import fresh, id_of, looked_up, mix, pieces, quoted, ranges, stash, tidy, word_hashes, word_spans

THRESHOLD, RECALL, WORDS = 0.8, 0.995, 5
#: The bitmap of candidate classes: 2**25 bits are 4 MB, in 64 slots.
BITS, SLOTS = 25, 64
#: Texts of a batch handled at a time, in bytes.
TOGETHER = 4_000_000


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 7) -> tuple[int, int]:
    """(bands, rows): enough bands that a pair exactly at the threshold shares one with probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    count = np.diff(first)
    size = np.minimum(count, n)
    made = np.where(count, count - size + 1, 0)
    at, own = ranges(first[:-1], made), np.repeat(np.arange(len(made)), made)
    g = np.zeros(len(at), np.uint64)
    for k in range(n):
        inside = size[own] > k
        g[inside] = mix(g[inside] * np.uint64(0x9E3779B97F4A7C15) + h[at[inside] + k])
    cut = np.concatenate([[0], np.cumsum(made)])
    return [np.unique(g[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def fingerprint(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band from the minima of rows permutations of the hashes' upper halves."""
    rng = np.random.Generator(np.random.PCG64(5))
    k = bands * rows
    a, b = rng.integers(0, 2**32, (2, k, 1), np.uint32)
    upper = (values >> np.uint64(32)).astype(np.uint32)
    low = np.full(k, 2**32 - 1, np.uint32)
    for at in range(0, len(upper), 16_384):
        low = np.minimum(low, (upper[None, at : at + 16_384] * (a | np.uint32(1)) + b).min(axis=1))
    low = low.astype(np.uint64).reshape(bands, rows)
    h = np.arange(bands, dtype=np.uint64) * np.uint64(1_000_003)
    for r in range(rows):
        h = mix(h ^ low[:, r]) + np.uint64(r)
    return h.view(np.int64)


def bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of the lower BITS of every id: 2**BITS bits whatever the number of ids."""
    per = 2**BITS // SLOTS

    def run(table: pa.Table) -> pa.Table:
        at = table["bit"].to_numpy()
        bits = np.zeros(per, bool)
        bits[at % per] = True
        return pa.table({"slot": pa.array([int(at[0] // per)], pa.int64()), "bits": pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())})

    rows = ids.select(F.col(ids.columns[0]).bitwiseAND(2**BITS - 1).alias("bit")).distinct()
    found = rows.withColumn("slot", F.floor(F.col("bit") / per)).groupBy("slot").applyInArrow(tidy(run), "slot long, bits binary").collect()
    out = np.zeros(2**BITS, bool)
    for r in found:
        out[r["slot"] * per : (r["slot"] + 1) * per] = np.unpackbits(np.frombuffer(zlib.decompress(r["bits"]), np.uint8)).astype(bool)
    return np.packbits(out)


def marked(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids & (2**BITS - 1)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def jaccard_verifier(threshold: float):
    """Links rows whose ``set`` (distinct unsigned 64-bit values) has at least the threshold's Jaccard similarity."""

    def verify(columns: dict, split: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sets = [np.frombuffer(s, "<u8") for s in columns["set"].to_pylist()]
        size = np.array([len(s) for s in sets])
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        end = np.cumsum(size)
        start = end - size
        mark = np.zeros(len(values), np.int32)
        for x in range(split or len(sets)):
            first = split or x + 1
            if first >= len(sets):
                break
            own = ids[start[x] : end[x]]
            mark[own] = 1
            both = np.add.reduceat(mark[ids[start[first] :]], start[first:] - start[first])
            mark[own] = 0
            # (1 + t) * both >= t * (a + b) is both / (a + b - both) >= t; the slack is for rounding
            y = np.flatnonzero(both >= threshold * (size[x] + size[first:] - both) - 1e-9)
            if len(y):
                yield np.full(len(y), x), y + first

    return verify


def _linked(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float, words: int) -> DataFrame:
    """A row per row of docs: doc_id, key (xxhash64 of the text), copy (of its shingle set), root (its class's, both null without shingles), copy_id, class_id, n_links."""
    spark = docs.sparkSession
    bands, rows = plan_bands(threshold, recall)
    texts = docs.select(id_of(docs, id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"), F.xxhash64(quoted(text_col).cast("string")).alias("key"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, at in pieces(b.column(1), TOGETHER):
                sets = shingles(data, at, words)
                copy = [fingerprint(s) if len(s) else None for s in sets]
                keys = [band_keys(s, bands, rows) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sets)), b.column(2).slice(first, len(sets)), pa.array(copy, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "key", "copy", "keys"])

    signed = stash(texts.mapInArrow(tidy(sign), "doc_id long, key long, copy long, keys array<long>"), "signatures")
    classes = stash(signed.where("copy IS NOT NULL").groupBy("copy").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n"), F.first("keys").alias("keys")), "gram-classes")
    members = classes.select(F.col("copy").alias("id"), F.explode("keys").alias("key"))
    clusters = components(bucket_edges(members, "gram"), "gram-candidates").select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    clusters = stash(clusters, "gram-clusters")
    bits = spark.sparkContext.broadcast(bitmap(clusters.select("id")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, at in pieces(b.column(1), TOGETHER):
                sets = [s for s in shingles(data, at, words) if len(s)]
                ids = np.array([fingerprint(s) for s in sets], np.int64)
                _, once = np.unique(ids, return_index=True)
                once = [i for i, ok in zip(once, marked(bits.value, ids[once]), strict=True) if ok]
                yield pa.RecordBatch.from_arrays([pa.array(ids[once]), pa.array([sets[i].tobytes() for i in once], pa.binary())], names=["id", "set"])

    sets = texts.select("key", "text").mapInArrow(tidy(gather), "id long, set binary").groupBy("id").agg(F.first("set").alias("set"))
    sets = stash(sets.withColumn("bytes", F.octet_length("set")), "gram-sets")
    inside = clusters.join(classes.select(F.col("copy").alias("id"), "n"), "id").withColumn("at", F.array("id"))
    found = stash(verified(inside, sets, jaccard_verifier(threshold), "gram"), "gram-links")
    links = found.groupBy("id").agg(F.sum("n_links").alias("linked"))
    roots = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")), "gram-links").withColumnRenamed("node", "id")
    # only classes of several documents or with links are looked up; hot ones need no shuffle of their documents
    facts = classes.select(F.col("copy").alias("id"), "copy_id", "n").join(links, "id", "left").join(roots, "id", "left").where("n > 1 OR linked > 0")
    facts = stash(facts.select("id", "copy_id", F.coalesce("root", "id").alias("root"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links")), "gram-facts")
    smallest = facts.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    facts = looked_up(facts, smallest, "root", "inner", "gram-roots").withColumnRenamed("id", "copy")
    out = looked_up(signed.select("doc_id", "key", "copy"), facts, "copy", "left", "gram-found")
    alone = F.col("root").isNull()
    pick = lambda c, other: F.when(alone, F.col(other)).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", "key", "copy", pick("root", "copy"), pick("copy_id", "doc_id"), pick("class_id", "doc_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """doc_id, class_id, n_links, copy_id of every row of docs.

    copy_id: smallest doc_id with the same shingle set. n_links: other documents whose
    shingle sets have at least the threshold's Jaccard similarity, copies included.
    class_id: smallest doc_id reachable by links, itself included.

    Null and empty texts and those of white space alone have no shingles and link with
    nothing. Repeated rows link with each other; a null id is never the smallest unless a
    whole class has none (class_id is then null). Texts of any length count whole. An empty
    table gives no rows. Other columns of docs are not read.
    """
    return _linked(docs, id_col, text_col, threshold, recall, words).select("doc_id", "class_id", "n_links", "copy_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """docs with one row of each class of near copies: that of the smallest doc_id (null last), and of rows with this id that of the smallest hash of its text.

    If rows repeat that one, id and text, one of them stays. Rows without shingles all stay,
    as do rows of other classes whatever ids they share. Columns stay as they are, whatever
    their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    found = stash(_linked(docs, id_col, text_col, threshold, recall, words).where("root IS NOT NULL").select("doc_id", "key", "root"), "gram-rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    several = found.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    inside = looked_up(found, several, "root", "inner", "gram-several").withColumn("stays", F.col("first").eqNullSafe(place))
    verdict = inside.groupBy("doc_id", "key").agg(F.first("stays").alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1")
    verdict = stash(verdict.select(F.col("doc_id").alias("id"), "key", "stays"), "gram-gone")
    bits = spark.sparkContext.broadcast(bitmap(verdict.select("key")))

    @F.arrow_udf(T.BooleanType())
    def concerned(key: pa.Array) -> pa.Array:
        return pa.array(marked(bits.value, key.to_numpy()))

    key, mark, at, first = (fresh(docs, c) for c in ("_key", "_mark", "_at", "_first"))
    keyed = docs.withColumn(key, F.xxhash64(quoted(text_col).cast("string"))).withColumn(mark, concerned(key))
    own = id_of(docs, id_col)
    near = keyed.where(mark).alias("d").join(verdict.where("NOT stays").alias("v"), own.eqNullSafe(F.col("v.id")) & (F.col(f"d.{key}") == F.col("v.key")), "left_anti")
    again = verdict.where("stays")
    if not again.isEmpty():  # which row stays is written down, so that it does if a task runs again
        near = stash(near.withColumn(at, F.monotonically_increasing_id()), "gram-again")
        same = own.eqNullSafe(F.col("v.id")) & (F.col(f"d.{key}") == F.col("v.key"))
        firsts = near.alias("d").join(again.alias("v"), same).groupBy("v.id", "v.key").agg(F.min(at).alias(first))
        near = near.alias("d").join(stash(firsts, "gram-firsts").alias("v"), same, "left").where(F.col(first).isNull() | (F.col(at) == F.col(first)))
    columns = [quoted(c) for c in docs.columns]
    return keyed.where(~F.col(mark)).select(*columns).unionByName(near.select(*[F.col(f"d.{'`' + c.replace('`', '``') + '`'}") for c in docs.columns]))
