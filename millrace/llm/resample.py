"""Drawing documents that resemble a target by importance weights of hashed features.

Features are runs of one to three words, hashed into a fixed number of buckets. One pass
over each table counts buckets; a bucket's gain is the scaled logarithm of its share in the
target over its share in the documents. The gains are an array of fixed size that every task
has, and a second pass adds up each document's gains. Scores are whole numbers: weight plus
a Gumbel-distributed offset from the document's id, so the highest scores are a sample
without replacement in proportion to the weights.

The draw sorts nothing as a whole. A histogram of scores is summed from the highest on, which
gives every score the rank of its first document and the score at which the draw ends; only
documents at or above it are numbered, by id within their score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import Running, scan
from .common import LONG_WORD, LOWER, flat, id_of, looked_up, quoted, stash, tidy, word_spans

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, (5, 100), 20, 42
#: Bytes of texts whose words are handled at a time; a longer text is taken in windows.
TOGETHER = 2_000_000

#: True for the bytes between words: all of ASCII but digits and letters.
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[128:] = False
for first, last in ("09", "az", "AZ"):
    BETWEEN[ord(first) : ord(last) + 1] = False


def _table() -> np.ndarray:
    """What one byte makes of the checksum, by the reflected polynomial of CRC-32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_BYTE = _table()


def _shifts(n: int) -> np.ndarray:
    """What n or fewer zero bytes after it make of each byte of a checksum: by number of bytes, place and value."""
    out = np.empty((n + 1, 4, 256), np.uint32)
    for place in range(4):
        out[0, place] = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
    for i in range(n):
        out[i + 1] = _BYTE[out[i] & 255] ^ (out[i] >> np.uint32(8))
    return out


_SHIFT = _shifts(64)


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


def joined(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the concatenations, from both parts' and the second one's number of bytes."""
    few = np.minimum(size, 64)
    c = _SHIFT[few, 0, a & 255] ^ _SHIFT[few, 1, (a >> 8) & 255] ^ _SHIFT[few, 2, (a >> 16) & 255] ^ _SHIFT[few, 3, a >> 24]
    more = np.flatnonzero(size > 64)
    if len(more):
        left, at, power = size[more] - 64, c[more], _SHIFT[1]
        while left.any():
            at = np.where(left & 1, _apply(power, at), at)
            left, power = left >> 1, np.stack([_apply(power, p) for p in power])
        c[more] = at
    return c ^ b


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, all words a byte at a time."""
    c, size = np.full(len(starts), 0xFFFFFFFF, np.uint32), ends - starts
    todo, step = np.flatnonzero((size > 0) & (size <= LONG_WORD)), 0
    while len(todo):
        c[todo] = _BYTE[(c[todo] ^ data[starts[todo] + step]) & 255] ^ (c[todo] >> np.uint32(8))
        step += 1
        todo = todo[size[todo] > step]
    c ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG_WORD):
        c[i] = zlib.crc32(data[starts[i] : ends[i]])
    return c


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the run of one, two and three words that ends at each word (`buckets` where there is none), lower-case data; runs by length, and each text's first word."""
    starts, ends, first = word_spans(data, offsets, BETWEEN)
    out = np.full((3, len(starts)), buckets, np.int64)
    if not len(starts):
        return out, ends - starts, first
    c, size = checksums(data, starts, ends), ends - starts
    left = np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first))  # words before it in its text
    run = c
    out[0] = c % buckets
    for n in (1, 2):
        spaced = run ^ np.uint32(0xFFFFFFFF)
        spaced = _BYTE[(spaced ^ np.uint32(0x20)) & 255] ^ (spaced >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
        # run[i] is of the n words that end at i; with the next word, of n + 1 that end there
        longer = np.zeros(len(c), np.uint32)
        longer[1:] = joined(spaced[:-1], c[1:], size[1:])
        run = longer
        ok = left >= n
        out[n][ok] = run[ok] % buckets
    return out, size, first


def windows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Index of the first text, lower-case bytes, offsets, and how many words at the start were in the window before.

    Short texts come together; a long one in windows that begin with the last two words of the one before.
    """
    data, at = flat(column)
    first = 0
    while first < len(at) - 1:
        last = min(max(first + 1, int(np.searchsorted(at, at[first] + TOGETHER, "right")) - 1), len(at) - 1)
        whole = data[at[first] : at[last]]
        if last > first + 1 or len(whole) <= TOGETHER:
            yield first, LOWER[whole], at[first : last + 1] - at[first], 0
        else:
            begin, before = 0, [np.zeros(0, np.uint8)] * 2
            while begin < len(whole):
                end = min(begin + TOGETHER, len(whole))
                while end < len(whole) and not BETWEEN[whole[end]]:  # a word isn't cut
                    gaps = np.flatnonzero(BETWEEN[whole[end : end + TOGETHER]])
                    end = end + int(gaps[0]) if len(gaps) else min(end + TOGETHER, len(whole))
                part = LOWER[whole[begin:end]]
                seen = [w for w in before if len(w)]
                gap = np.array([32], np.uint8)
                part = np.concatenate([*(x for w in seen for x in (w, gap)), part])
                yield first, part, np.array([0, len(part)]), len(seen)
                starts, ends, _ = word_spans(part, np.array([0, len(part)]), BETWEEN)
                before = [part[a:b] for a, b in zip(starts[-2:], ends[-2:], strict=True)]
                begin = end
        first = last


def _new(out: np.ndarray, seen: int) -> np.ndarray:
    """Without the runs that end in a word of the window before."""
    return out[:, seen:]


def bucket_counts(texts: DataFrame, text_col: str, buckets: int) -> list[int]:
    """How many features fall in each bucket; each task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets + 1, np.int64)
        for b in batches:
            for _, data, offsets, seen in windows(b.column(0)):
                n += np.bincount(_new(features(data, offsets, buckets)[0], seen).reshape(-1), minlength=buckets + 1)
        some = np.flatnonzero(n[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], names=["bucket", "n"])

    rows = texts.select(quoted(text_col).cast("string").alias("text")).mapInArrow(tidy(count), "bucket long, n long")
    out = [0] * buckets
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # `buckets` rows at most
        out[bucket] = n
    return out


def gains(own: list[int], target: list[int], scale: int = 1000) -> np.ndarray:
    """floor(scale * ln(share in target / share in own)) of every bucket, one added to each count."""
    k, s, t = len(own), float(sum(own)), float(sum(target))
    return np.array([math.floor(scale * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(own, target, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of its features' gains) of every document."""
    by_bucket, buckets = np.append(gain, 0), len(gain)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, runs, weight = (np.zeros(len(b), np.int64) for _ in range(3))
            for at, data, offsets, seen in windows(b.column(1)):
                out, _, first = features(data, offsets, buckets)
                out, first = _new(out, seen), np.maximum(first - seen, 0)
                own = slice(at, at + len(first) - 1)
                words[own] += np.diff(first)
                for into, each in ((runs, (out < buckets).sum(axis=0)), (weight, by_bucket[out].sum(axis=0))):
                    total = np.concatenate([[0], np.cumsum(each)])
                    into[own] += total[first[1:]] - total[first[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in (words, runs, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(id_of(docs, id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(add), "doc_id long, n_words long, n_features long, weight long")


def draw(scored: DataFrame, share: tuple[int, int], least_words: int) -> DataFrame:
    """scored (doc_id, n_words, score and others, a stored table) with rank: 1, 2, 3... from the highest score on, null if not drawn."""
    fit = scored.where(F.col("n_words") >= least_words)
    histogram = fit.groupBy("score").agg(F.count("*").alias("n"))
    above = stash(scan(histogram, [], [F.desc("score")], {"upto": Running("sum", "n")}), "resample-histogram")
    total = above.agg(F.max("upto")).first()[0] or 0
    wanted = share[0] * total // share[1]
    places = above.where(F.col("upto") - F.col("n") < wanted).select("score", (F.col("upto") - F.col("n")).alias("before"))
    cutoff = places.agg(F.min("score")).first()[0]
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    drawn = (F.col("n_words") >= least_words) & (F.col("score") >= cutoff)
    numbered = scan(scored.where(drawn), ["score"], [F.asc_nulls_last("doc_id")], {"place": Running("count", F.lit(1))})
    numbered = looked_up(numbered, places, "score", "inner", "resample-places").withColumn("rank", F.col("before") + F.col("place"))
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")).cast("long"))
    return numbered.select(*scored.columns, "rank").unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document.

    rank is 1, 2, 3... by falling score among the floor(share) documents drawn of those with
    at least least_words words; null for others. Ties go to the smaller doc_id, null last;
    rows that share an id and a score are each numbered, in an order of their own. A null,
    empty or wordless text has no features and weight 0; texts of any length are taken whole.
    A null id hashes as an empty one. An empty table gives no rows, an empty target the same
    target count for all buckets. Ids must be numbers. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    offset = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stash(weigh(docs, gain, id_col=id_col, text_col=text_col).withColumn("score", F.col("weight") + offset), "resample-scored")
    return draw(scored, share, least_words)
