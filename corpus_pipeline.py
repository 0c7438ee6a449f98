"""A corpus from raw documents to packed sequences: five stages, each written and read again by the next.

Every stage takes any rows: null ids, texts, languages and sources, repeated rows and ids,
texts of any length, empty tables and further columns, whatever their names, which all but
the last stage pass on. Needs the training-data subpackage; without it, this module can't be
imported.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import grams, langid, lines, mixing, packing
from millrace.llm.common import stash

#: Spark's own limit of an Arrow batch, and what the stages set where the session sets none. Spark and a Python
#: worker each hold up to two batches of texts at a time for every core; results don't depend on their size.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, with that limit set for the session, as a stage's rows are made only when its caller writes them."""

    @wraps(stage)
    def limited(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not spark.conf.get(BATCH_LIMIT, None):
            spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return limited


@in_small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language can't be told: null, without letters, or far from every centroid. Repeated rows stay or go together."""
    return langid.accepted(langid.fit(docs), docs)


@in_small_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the lines that repeat an earlier one, exactly or nearly; of rows with the same id and text all but the first lose every line. A document goes if every line of it that has words does; null and blank texts stay."""
    return lines.without_repeated_lines(docs, drop_emptied=True)


@in_small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest id, null last. Documents without words have no copies and stay."""
    return grams.one_of_each(docs)


@in_small_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents as often as its target needs; repeats are rows. A null source is one of its own; ties at a target are parted."""
    return mixing.mixed(docs)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left: a row per piece of a document in a sequence, with its ids as little-endian unsigned 32-bit numbers. An empty or null text is its end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("mix", mix),
    ("pack", pack),
]

#: No stage but the mix can be said in SQL. tests/llm/test_pipeline.py holds every stage against a brute-force version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
