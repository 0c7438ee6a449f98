"""Language identification against a plain version of its vectors and cosines, its centroids' own condition, and garbled texts."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")


@pytest.fixture(scope="module")
def model(documents):
    return langid.fit(documents.where("crc32(cast(doc_id AS string)) % 3 <> 1"))


def plain_counts(text: str) -> Counter:
    """Hashed n-grams of a text, a character at a time: a space, the text, a space. Runs within the text and its last space are one; the space before it stays apart."""
    body = ""
    for c in text.lower() + " ":
        if c.isalpha():
            body += c
        elif not body.endswith(" "):
            body += " "
    said = " " + body
    out: Counter = Counter()
    for n in (2, 3):
        for at in range(len(said) - n + 1):
            h = ord(said[at])
            for c in said[at + 1 : at + n]:
                h = (h * 0x100000001B3 + ord(c)) % 2**64
            out[(h * 0x9E3779B97F4A7C15 % 2**64) >> 51] += 1
    return out


def plain_nearest(model, text: str) -> tuple[str, float, int]:
    weights = {k: math.log1p(v) * float(model.idf[k]) for k, v in plain_counts(text).items()}
    norm = math.sqrt(sum(v * v for v in weights.values())) or 1.0
    best = max(((sum(v * float(c[k]) for k, v in weights.items()) / norm, -i) for i, c in enumerate(model.centroids)))
    return model.languages[model.owner[-best[1]]], best[0], sum(c.isalpha() for c in text.lower())


def test_predictions_are_those_of_a_plain_version(spark, documents, model):
    odd = ["", "   ", "12 34", "é", "ß ẞ", "İi", "a", "Straße—über alles", "x" * 3000, "日本語の文章", "a1b2c3", "\n\nun deux\ttrois ", "the the the"]
    rows = [tuple(r) for r in documents.select("doc_id", "text").where("length(text) < 3000").collect()] + [(10**6 + i, t) for i, t in enumerate(odd)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), model).collect()}
    assert len(got) == len(rows) > 400
    for doc, text in rows:
        lang, cosine, letters = plain_nearest(model, text)
        if not letters:
            assert (got[doc]["lang_pred"], got[doc]["score"], got[doc]["rejected"]) == ("und", 0.0, True)
            continue
        assert abs(got[doc]["score"] - max(0.0, cosine)) < 1e-4 and got[doc]["lang_pred"] == lang, text
        limit = langid.REJECT_BELOW * model.floor[letters.bit_length()]
        assert abs(cosine - limit) < 1e-4 or got[doc]["rejected"] == (cosine < limit)


def test_centroids_are_means_of_what_is_nearest_to_them():
    r = np.random.default_rng(3)
    starts = langid._unit(r.normal(size=(3, 40)))
    x = langid._unit(np.repeat(starts, [50, 30, 20], axis=0) + 0.05 * r.normal(size=(100, 40)))
    c = langid._cluster(x, 3)
    near = np.argmax(x @ c.T, axis=1)
    assert sorted(np.bincount(near).tolist()) == [20, 30, 50]
    for i in range(3):
        mean = x[near == i].mean(axis=0)
        assert np.allclose(c[i], mean / np.linalg.norm(mean))
    assert len(langid._cluster(x[:2], 3)) == 2


def test_garbled_texts_are_rejected_and_others_kept(spark, documents, model):
    r = random.Random(6)

    def garbled(text: str) -> str:
        return "".join(r.choice("qxzjkvwbgfpy") if c.isalpha() else c for c in text)

    texts = [x["text"] for x in documents.where("crc32(cast(doc_id AS string)) % 3 = 1 AND lang IS NOT NULL AND length(text) > 200").collect()]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(i, garbled(t), 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bad int")
    found = {(x["bad"], x["rejected"]): x["count"] for x in langid.identify(df, model, keep={"bad": df["bad"]}).groupBy("bad", "rejected").count().collect()}
    assert found.get((0, True), 0) == 0 and found.get((1, True), 0) >= 0.98 * len(texts) > 100, found
