"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import render_pages

    return render_pages(_table(spark, sf_dir, "pages"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import text_media

    return text_media(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_scores

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return katz_scores(_table(spark, sf_dir, "documents"), ~held)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .grams import near_documents

    return near_documents(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import without_repeated_lines

    return without_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = identify(docs, fit(docs.where(~held)), keep={"held_out": held})
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest_columns, find_private

    return digest_columns(find_private(_table(spark, sf_dir, "documents")))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def linked_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's links on a table that has some: to every fifth vector come one like it and one like that, so most of these are components of three that hold by their middle."""
    from .embeddings import near_duplicates

    v = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    near = v.where("vec_id % 5 = 0").select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: x * (1 + 0.3 * (i % 3 - 1))).alias("embedding"))
    further = near.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: x * (1 + 0.3 * (F.floor(i / 3) % 3 - 1))).alias("embedding"))
    return near_duplicates(v.unionByName(near).unionByName(further))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .merges import encode

    found = encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return found.select("doc_id", tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (linked_embeddings, op1_mixing, op2_packing, op3_html, op4_media, op5_katz, op6_ngram_join, op7_line_dedup, op8_langid, op9_pii, op10_embeddings, op11_negatives, op12_resample, op13_sentencepiece)}


#: Every pair of vectors by its cosine, and every vector's smallest id reachable.
_OWN = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_WITH_NEAR = """
own AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
near AS (SELECT vec_id + 1000000000 AS vec_id, list_transform(x, lambda x, i: x * (1 + 0.3::DOUBLE * ((i - 1) % 3 - 1))) AS x FROM own WHERE vec_id % 5 = 0),
further AS (SELECT vec_id + 1000000000 AS vec_id, list_transform(x, lambda x, i: x * (1 + 0.3::DOUBLE * (((i - 1) // 3) % 3 - 1))) AS x FROM near),
v AS (SELECT * FROM own UNION ALL SELECT * FROM near UNION ALL SELECT * FROM further)"""
_LINKS = """
WITH RECURSIVE {v},
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE a = v.vec_id) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = v.vec_id
"""

#: Shingles of five words, pairs by the shingles they share, and every document's smallest id reachable.
_NGRAMS = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
link AS (
  SELECT a, b, common = na AND common = nb AS same FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN (SELECT doc_id AS a, n AS na FROM n) USING (a) JOIN (SELECT doc_id AS b, n AS nb FROM n) USING (b) WHERE 5 * common >= 4 * (na + nb - common)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, m.class_id, (SELECT count(*) FROM link WHERE a = w.doc_id) AS n_links, least(w.doc_id, (SELECT min(b) FROM link WHERE a = w.doc_id AND same)) AS copy_id
FROM w JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY a) m ON m.a = w.doc_id
"""


#: Every anchor's scores; its positives, and for each of them the rows of other labels between the limits.
_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> own AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

#: The checksum a byte at a time over distinct features, by a table of what one byte makes of it.
_RESAMPLE = """
WITH byte AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
w AS (SELECT 'd' AS t, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT t, id, f, count(*) AS n FROM (SELECT t, id, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w) GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
k AS (SELECT f, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, len(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT))), lambda c, b: xor(c >> 8, byte.t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS k FROM h, byte),
b AS (SELECT k, sum(n) FILTER (WHERE t = 'd') AS s, sum(n) FILTER (WHERE t = 'b') AS t FROM f JOIN k USING (f) GROUP BY k),
g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT sum(s) FROM b) + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT sum(t) FROM b) + 10000)))) AS BIGINT) AS g FROM b),
d AS (SELECT id, sum(n) AS n, sum(n * g) AS weight FROM f JOIN k USING (f) JOIN g USING (k) WHERE t = 'd' GROUP BY id),
o AS (SELECT id AS doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN d USING (id) WHERE t = 'd'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS of_all FROM o WHERE n_words >= 20)
SELECT o.doc_id, n_features, weight, score, CASE WHEN place <= 5 * of_all // 100 THEN place END AS rank FROM o LEFT JOIN r USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL can say what these queries find; the others are held against brute-force versions in tests/llm."""
    return {"op6_ngram_join": _NGRAMS, "op10_embeddings": _LINKS.format(v=_OWN), "linked_embeddings": _LINKS.format(v=_WITH_NEAR), "op11_negatives": _NEGATIVES, "op12_resample": _RESAMPLE}
