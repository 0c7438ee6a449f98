"""Language identification by nearest centroid.

A text is a TF-IDF vector of its character two- and three-grams (lower case, every run of
characters that aren't letters as one space), hashed to a fixed number of dimensions. Each
language has several centroids from spherical k-means; the most similar one by cosine gives
the language. A text is rejected if that cosine is far below what training texts of its
length reach.

The model is fitted on the driver from a bounded sample of each language's rows (``per_language``
texts, of longer ones ``sample_chars`` characters in spans); predicting is one map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few_rows, give_back, quoted, tidy

DIMENSIONS = 8192
PER_LANGUAGE, SAMPLE_CHARS, CENTROIDS = 400, 20_000, 3
#: Spans taken of a text of more than SAMPLE_CHARS characters, from start to end at equal distances.
SPANS = 10
#: With more languages than this, each has a smaller sample (one text at least), so that theirs together stays bounded.
LANGUAGES = 200
#: A text is rejected below this share of a low quantile of the cosines of training texts of its length.
REJECT_BELOW, FLOOR = 0.6, 0.002
#: Texts turned into vectors at a time, and their characters; a longer text is taken in windows of so many.
TOGETHER, LONG_TEXT = 128, 500_000


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with 32 for what isn't a letter, a space around each text; the text of each."""
    lower = [t.lower() for t in texts]
    joined = " " + "".join(x + " " for x in lower)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[~_letters()[codes]] = 32
    owner = np.repeat(np.arange(len(lower)), [len(x) + 1 for x in lower])
    return codes, np.concatenate([[-1], owner])


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """The dimension of the n-gram that starts at each place."""
    h = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        h = h * np.uint64(0x100000001B3) + codes[k : len(codes) - n + 1 + k]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)).astype(np.int64)


def _long_vector(text: str) -> tuple[np.ndarray, int]:
    """n-gram counts and number of letters of one text, a window at a time; windows share their last two characters."""
    counts, letters = np.zeros(DIMENSIONS), 0
    held = np.array([32], np.uint64)
    for at in range(0, len(text) + 1, LONG_TEXT):
        codes, _ = _codes([text[at : at + LONG_TEXT]])
        codes = (codes[1:] if at + LONG_TEXT > len(text) else codes[1:-1]).astype(np.uint64)  # the space after the text is its last one
        letters += int((codes != 32).sum())
        joined = np.concatenate([held, codes])
        keep = np.ones(len(joined), bool)
        keep[1:] = (joined[1:] != 32) | (joined[:-1] != 32)
        keep[: len(held) + (at == 0)] = True  # the space before a text is no part of it
        joined = joined[keep]
        for n in (2, 3):
            if len(joined) >= n:
                ends = np.arange(n - 1, len(joined))
                counts += np.bincount(_grams(joined, n)[ends >= len(held)], minlength=DIMENSIONS)
        held = joined[-2:]
    return counts, letters


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (a row per text) and the number of letters of each."""
    texts = [t or "" for t in texts]
    long = [i for i, t in enumerate(texts) if len(t) > LONG_TEXT]
    codes, owner = _codes([t if len(t) <= LONG_TEXT else "" for t in texts])
    letters = np.bincount(owner[codes != 32], minlength=len(texts))
    spaces = codes == 32
    keep = ~(spaces & np.concatenate([[False], spaces[:-1] & (owner[1:] == owner[:-1])]))
    codes, owner = codes[keep].astype(np.uint64), owner[keep].astype(np.int64)
    counts = np.zeros(len(texts) * DIMENSIONS)
    for n in (2, 3):
        if len(codes) < n:
            continue
        # the space before a text belongs to the one before it; nothing else of that one counts
        own = owner[1 : len(owner) - n + 2] == owner[n - 1 :]
        counts += np.bincount((owner[n - 1 :] * DIMENSIONS + _grams(codes, n))[own], minlength=len(counts))
    counts = counts.reshape(len(texts), DIMENSIONS)
    for i in long:
        counts[i], letters[i] = _long_vector(texts[i])
    return counts, letters


def _together(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of a bounded number and a bounded total length."""
    at, cut = 0, np.concatenate([[0], np.cumsum(np.minimum(sizes, LONG_TEXT))])
    while at < len(sizes):
        end = min(at + TOGETHER, max(at + 1, int(np.searchsorted(cut, cut[at] + LONG_TEXT, "right")) - 1), len(sizes))
        yield at, end
        at = end


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from farthest-first starts."""
    picked = [x.mean(axis=0)]
    for _ in range(1, min(k, len(x))):
        picked.append(x[np.argmin(np.max(x @ np.array(_unit(np.array(picked))).T, axis=1))])
    c = _unit(np.array(picked))
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = _unit(np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))]))
    return c


class Model:
    """Centroids with their languages, IDF weights, and the lowest cosine allowed by length."""

    def __init__(self, texts: list[str], languages: list[str], centroids: int = CENTROIDS):
        by_language: dict[str, list[str]] = {}
        for t, x in zip(texts, languages, strict=True):
            by_language.setdefault(x, []).append(t)
        self.languages = sorted(by_language)
        met = np.zeros(DIMENSIONS, np.int64)
        for i in range(0, len(texts), TOGETHER):
            met += (vectors(texts[i : i + TOGETHER])[0] > 0).sum(axis=0)
        self.idf = np.log((1 + len(texts)) / (1 + met)) + 1
        found = []
        for own in map(by_language.__getitem__, self.languages):  # vectors of one language at a time
            counts = np.concatenate([vectors(own[i : i + TOGETHER])[0] for i in range(0, len(own), TOGETHER)])
            found.append(_cluster(_unit(np.log1p(counts) * self.idf), centroids))
        self.centroids = np.concatenate(found).astype(np.float32) if found else np.zeros((0, DIMENSIONS), np.float32)
        self.owner = np.repeat(np.arange(len(found)), [len(c) for c in found])
        self.idf = self.idf.astype(np.float32)
        # spans of 1, 2, 4, ... words of the sample show how cosines fall with length
        seen: dict[int, list[float]] = {}
        spans = list(texts)
        for i, t in enumerate(texts):
            words = t.split()
            spans += [" ".join(words[(at := (i * 7919) % max(1, len(words) - n + 1)) : at + n]) for n in (1, 2, 4, 8, 16, 32, 64) if n <= len(words)]
        for i in range(0, len(spans), TOGETHER):
            some = spans[i : i + TOGETHER]
            cosine, _, letters = self.nearest(some)
            for c, n in zip(cosine, letters, strict=True):
                if n:
                    seen.setdefault(int(n).bit_length(), []).append(float(c))
        # not the lowest: a few garbled texts with a label would let all like them pass
        floor = {b: float(np.quantile(v, FLOOR)) for b, v in seen.items()}
        low, self.floor = 1.0, np.zeros(64)
        for b in range(63, 0, -1):  # a shorter text is never held to more than a longer one
            low = min(low, floor.get(b, 1.0))
            self.floor[b] = low if floor and b <= max(floor) else 0.0
        self.floor[[b for b in range(64) if floor and b > max(floor)]] = floor[max(floor)] if floor else 0.0

    def nearest(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cosine to the nearest centroid, its index, and the number of letters."""
        counts, letters = vectors(texts)
        x = _unit(np.log1p(counts).astype(np.float32) * self.idf)
        if not len(self.centroids):
            return np.zeros(len(texts)), np.zeros(len(texts), int), letters
        cosine = x @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        return np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float), best, letters

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is rejected, of each text."""
        names, scores, rejected = [], [np.zeros(0)], [np.zeros(0, bool)]
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        for at, end in _together(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)):
            texts = column.slice(at, end - at).to_pylist()
            cosine, best, letters = self.nearest(texts)
            none = (letters == 0) | (not len(self.centroids))
            names += ["und" if no else self.languages[self.owner[b]] for no, b in zip(none, best, strict=True)]
            scores.append(np.where(none, 0.0, cosine))
            rejected.append(none | (cosine < REJECT_BELOW * self.floor[np.minimum([int(n).bit_length() for n in letters], 63)]))
        return names, np.concatenate(scores), np.concatenate(rejected)


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on per_language distinct texts of each language, those of the smallest hashes, or on all if there are fewer.

    Rows whose language or text is null aren't used. Of a text longer than sample_chars, SPANS
    spans of that many characters together are. With over LANGUAGES languages, per_language is
    lowered to keep the sample's size. Copies of a text count once, also in how many a language has. Nothing to learn from gives a model that rejects all.
    """
    rows = labelled.select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    most = 2**31
    rows = rows.withColumn("place", F.pmod(F.xxhash64("text"), F.lit(most)))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts")).collect()
    if not counts:
        return Model([], [])
    per_language = max(1, min(per_language, PER_LANGUAGE * LANGUAGES // len(counts)))
    # twice as many as wanted and some more, so that chance and the estimate's error leave enough
    rates = few_rows(rows.sparkSession, [(r["lang"], int(min(1.0, (2 * per_language + 50) / r["texts"]) * most)) for r in counts], pa.schema([("lang", pa.string()), ("below", pa.int64())]))
    some = rows.join(F.broadcast(rates), "lang").where("place < below")
    # rows of one text pass or fail together, so copies are removed before anything is gathered
    size = max(1, sample_chars // SPANS)
    spans = F.expr(f"CASE WHEN length(text) <= {sample_chars} THEN text ELSE array_join(transform(sequence(0, {SPANS - 1}), i -> substring(text, cast(1 + i * (length(text) - {size}) div {SPANS - 1} AS int), {size})), ' ') END")
    some = some.select("lang", "place", spans.alias("text"))
    found = some.groupBy("lang", "text").agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))  # of what is sampled, so bounded
    found = sorted(found.withColumn("rank", rank).where(F.col("rank") <= per_language).collect(), key=lambda r: (r["place"], r["lang"], r["text"]))
    return Model([r["text"] for r in found], [r["lang"] for r in found])


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, rejected (and keep's columns, under other names) of every row of docs.

    lang_pred is one of the model's languages, ``und`` with score 0 if the text is null or
    has no letter; rejected is true for those and for texts too far from every centroid.
    Texts of any length count whole, long ones in windows. Of languages equally near, the
    first by name is given. Repeated rows and null ids give a row each, columns may have any
    names, and an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids of a fixed size
    extra = keep or {}
    if {n.lower() for n in extra} & {"doc_id", "lang_pred", "score", "rejected"} or len({n.lower() for n in extra}) < len(extra):
        raise ValueError("keep's names must differ from each other and from doc_id, lang_pred, score and rejected")
    rows = docs.select(quoted(text_col).cast("string").alias("_text"), quoted(id_col).alias("doc_id"), *[c.alias(n) for n, c in extra.items()])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, rejected = sent.value.predict(b.column(0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], names=schema.names)

    return rows.mapInArrow(tidy(run), schema)


def accepted(model: Model, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text the model doesn't reject, unchanged, whatever their columns' names; rows with a null text go."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.BooleanType())
    def keeps(text: pa.Array) -> pa.Array:
        kept = pa.array(~sent.value.predict(text)[2])
        give_back()
        return kept

    return docs.where(keeps(quoted(text_col).cast("string")))
