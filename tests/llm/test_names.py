"""Columns in another case, with dots in their names, and ids that aren't numbers, for every operator."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import embeddings, grams, html, katz, langid, lines, media, merges, mixing, negatives, packing, pii, resample

WORD_BPE = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
PIECE_BPE = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")

#: Operators over documents: what each makes of (docs, id column, text column, another column).
DOCUMENTS = {
    "mixing": lambda d, i, t, o: mixing.mix_sources(d, id_col=i, text_col=t, source_col=o),
    "packing": lambda d, i, t, o: packing.pack_documents(d, WORD_BPE, id_col=i, text_col=t),
    "html": lambda d, i, t, o: html.render_pages(d, id_col=i, html_col=t),
    "media": lambda d, i, t, o: media.text_media(d, id_col=i, text_col=t),
    "katz": lambda d, i, t, o: katz.katz_scores(d, F.lit(True), id_col=i, text_col=t),
    "grams": lambda d, i, t, o: grams.near_documents(d, id_col=i, text_col=t),
    "grams of each": lambda d, i, t, o: grams.one_of_each(d, id_col=i, text_col=t),
    "lines": lambda d, i, t, o: lines.without_repeated_lines(d, id_col=i, text_col=t),
    "langid": lambda d, i, t, o: langid.identify(d, langid.fit(d, text_col=t, lang_col=o), id_col=i, text_col=t),
    "pii": lambda d, i, t, o: pii.find_private(d, id_col=i, text_col=t),
    "resample": lambda d, i, t, o: resample.resample(d, d, id_col=i, text_col=t, target_col=t),
    "merges": lambda d, i, t, o: merges.encode(d, PIECE_BPE, id_col=i, text_col=t),
}
#: These give ids back as they came.
ANY_ID = {"mixing", "langid", "merges"}


def rows(ids) -> list[tuple]:
    r = random.Random(1)
    return [(i, "\n".join(" ".join(r.choice(["sun", "moon", "star", "sky", "sea", "hill", "tree"]) for _ in range(9)) for _ in range(8)), "ab"[k % 2]) for k, i in enumerate(ids)]


@pytest.mark.parametrize("name", DOCUMENTS)
def test_columns_of_any_name(spark, name):
    plain = spark.createDataFrame(rows(range(12)), "doc_id long, text string, other string").coalesce(1)
    want = sorted(map(str, map(tuple, DOCUMENTS[name](plain, "doc_id", "text", "other").collect())))
    dotted = plain.toDF("d.id", "a.b", "o`x")
    assert sorted(map(str, map(tuple, DOCUMENTS[name](dotted, "d.id", "a.b", "o`x").collect()))) == want
    upper = plain.toDF("DOC_ID", "TEXT", "Other")
    assert sorted(map(str, map(tuple, DOCUMENTS[name](upper, "doc_id", "text", "other").collect()))) == want


@pytest.mark.parametrize("name", DOCUMENTS)
def test_ids_that_are_text(spark, name):
    docs = spark.createDataFrame(rows("abcd"), "doc_id string, text string, other string")
    if name in ANY_ID:
        assert {r[0] for r in DOCUMENTS[name](docs, "doc_id", "text", "other").collect()} == set("abcd")
    else:
        with pytest.raises(TypeError, match="whole numbers"):
            DOCUMENTS[name](docs, "doc_id", "text", "other")


@pytest.mark.parametrize("name", ["embeddings", "negatives"])
def test_vectors_of_any_name(spark, name):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, i % 2, r.standard_normal(4).tolist()) for i in range(40)], "vec_id long, label int, embedding array<double>")
    made = {
        "embeddings": lambda d, i, g, v: embeddings.near_duplicates(d, id_col=i, vector_col=v, threshold=0.8),
        "negatives": lambda d, i, g, v: negatives.hard_negatives(d, F.col(f"`{i}`") % 10 == 0, id_col=i, label=g, vector_col=v),
    }[name]
    want = sorted(map(tuple, made(df, "vec_id", "label", "embedding").collect()))
    assert sorted(map(tuple, made(df.toDF("v.id", "l.a", "e.m"), "v.id", "l.a", "e.m").collect())) == want != []
    assert sorted(map(tuple, made(df.toDF("VEC_ID", "LABEL", "Embedding"), "vec_id", "label", "embedding").collect())) == want
    with pytest.raises(TypeError, match="whole numbers"):
        made(df.withColumn("vec_id", F.lit("x")), "vec_id", "label", "embedding")


def test_line_counts_replace_columns_in_any_case(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (2, "a b", 8)], "doc_id long, TEXT string, N_Lines int")
    got = lines.without_repeated_lines(docs, counts=True)
    assert got.columns == ["doc_id", "TEXT", "n_lines", "n_removed"] and {tuple(r) for r in got.collect()} == {(1, "a b", 1, 0), (2, "", 1, 1)}


def test_kept_columns_need_names_of_their_own(spark):
    docs = spark.createDataFrame(rows(range(4)), "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.identify(docs, langid.fit(docs), keep={"doc_id": F.lit(1)})


def test_frequent_words_meet_by_pairs(spark, monkeypatch):
    """All words count as frequent, so lines below the limit of words meet by pairs, those above by words, and at the limit both ways."""
    r = random.Random(2)
    monkeypatch.setattr(lines, "HOT_CODE", 3)
    monkeypatch.setattr(lines, "PAIR_WORDS", 12)
    texts = []
    for k in range(260):
        words = [f"w{r.randint(0, 40)}" for _ in range(r.randint(2, 24))]
        if k % 2:
            words = texts[r.randrange(len(texts))].split()
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = f"w{r.randint(0, 40)}"
            words += ["x", "y"][: r.randint(0, 2)]
        texts.append(" ".join(words))
    before, want = [], {}
    for i, t in enumerate(texts):
        s = set(t.split())
        want[i] = "" if any(len(s & b) / len(s | b) >= 0.8 - 1e-12 for b in before) else t
        before.append(s)
    got = lines.without_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {x["doc_id"]: x["text"] for x in got.collect()} == want


def test_short_lines_of_few_words_take_time_in_proportion():
    r = np.random.default_rng(3)
    took = []
    import time

    for n in (10_000, 40_000):
        h = np.sort(r.integers(0, 2**63, 60).astype(np.uint64))
        sets = [np.sort(r.choice(60, 8, replace=False)) for _ in range(n)]
        cut, flat = np.arange(0, 8 * n + 1, 8), h[np.concatenate(sets)]
        ids = lines.class_ids(cut, flat)
        began = time.process_time()
        entries, _ = lines._prefix_entries(cut, flat, np.full(len(flat), 40), ids, 0.8, 1)
        lines.candidate_edges(entries, 0.8)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1 and took[1] < 20
    print(took)
