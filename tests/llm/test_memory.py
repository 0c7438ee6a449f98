"""What operators hold in memory beside the rows they are given."""

import random
import tracemalloc
import weakref

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import common, langid, mixing, packing

DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture
def limit(spark):
    """The setting of an Arrow batch's bytes, unset at first and at the end."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    yield "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_counting_words_holds_little_beside_the_texts():
    texts = pa.array(["some words of a text " * 200] * 2000)
    common.word_count.func(texts.slice(0, 10))
    tracemalloc.start()
    try:
        assert common.word_count.func(texts).to_pylist() == [1000] * 2000
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert texts.nbytes > 8_000_000 and held < 16_000_000, held


def test_words_are_counted_across_windows(monkeypatch):
    rng = random.Random(3)
    for window in (1, 2, 3, 7, 64):
        monkeypatch.setattr(common, "WINDOW", window)
        for _ in range(100):
            texts = [None if rng.random() < 0.1 else "".join(rng.choices("ab \n\x0bé ", k=rng.choice([0, 0, 1, 2, 5, 40]))) for _ in range(rng.randint(0, 12))]
            data, offsets = common.flat(pa.array(texts, pa.string()))
            assert common.words_in(data, offsets).tolist() == [len((t or "").encode().split()) for t in texts]
            assert np.array_equal(common.words_in(data, offsets), np.diff(common.word_spans(data, offsets)[2])[: len(texts)])


def test_tables_of_few_rows_start_no_workers(spark, capsys, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words {i}", "en", "ab"[i % 2] if i % 5 else None) for i in range(20)], DOCS)
    docs = common.stash(docs.unionByName(docs), "few")  # rows repeat, so that ties are parted too
    made, kept = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: made.append(kept(*a, **k)) or made[-1])
    mixing.mixed(docs).count()
    langid.fit(docs)
    assert len(made) > 3
    for df in made:
        capsys.readouterr()
        df.explain()
        plan = capsys.readouterr().out
        assert "LocalTableScan" in plan and "RDD" not in plan, plan


def test_stages_take_texts_in_small_batches(spark, limit):
    docs = common.stash(spark.createDataFrame([(i, "word " * 20_000, "en", "a") for i in range(300)], DOCS).coalesce(1), "wide")

    def largest() -> int:
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long")
        return sizes.groupBy().max("n").first()[0]

    assert corpus_pipeline.mix(spark, docs, "").columns == docs.columns
    assert largest() < 10_000_000
    spark.conf.set(limit, "2m")  # the session's own stays
    corpus_pipeline.mix(spark, docs, "")
    assert spark.conf.get(limit) == "2m"


def test_results_do_not_depend_on_batches(spark, limit, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = ["\n".join(" ".join(rng.choices(words, k=9)) for _ in range(6)) for _ in range(120)]
    rows = [(i, texts[i % 100], "en", "abc"[i % 3]) for i in range(120)] + [(500, None, None, None), (501, "", "en", "a"), (502, texts[3] + " more", "en", "a")]
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(f"{tmp_path}/docs")
    found = []
    for size in ("64m", "1k"):
        spark.conf.set(limit, size)
        docs = spark.read.parquet(f"{tmp_path}/docs")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, docs, "").write.parquet(f"{tmp_path}/{size}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{size}-{name}")
        pieces = corpus_pipeline.pack(spark, docs, "").selectExpr("doc_id", "doc_tokens", "length").collect()
        found.append((sorted(map(str, docs.collect())), sum(r["length"] for r in pieces), sorted({(r["doc_id"], r["doc_tokens"]) for r in pieces})))
    assert found[0] == found[1] and len(found[0][0]) > 50


def test_packing_keeps_no_words_when_memory_is_given_back(spark, monkeypatch):
    ran, tables, freed = [], [], []
    monkeypatch.setattr(packing, "tidy", lambda run: ran.append(run) or common.tidy(run))
    corpus_pipeline.pack(spark, spark.createDataFrame([(1, "a", "en", "a")], DOCS), "")
    made = packing.WordTable.__init__
    monkeypatch.setattr(packing.WordTable, "__init__", lambda self: made(self) or tables.append(weakref.ref(self)))
    monkeypatch.setattr(common, "give_back", lambda: freed.append([t() is None for t in tables]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", None])], names=["doc_id", "text"])
    assert sum(b.num_rows for b in common.tidy(ran[0])(iter([batch]))) > 1
    assert freed[-1] == [True]
