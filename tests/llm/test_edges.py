"""Rows that operators must take without a crash or a loss: shared and null ids, repeated rows, clashing names, very long texts; and recall at the thresholds."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import embeddings, grams, lines, mixing, packing

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
WORDS = [f"w{i}" for i in range(4000)]


def prose(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


def deduped(spark, rows, **options) -> list:
    return lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()


@pytest.mark.parametrize("texts", [[None], ["one two three"], ["a\nb\nc"], ["", "\n\n"]])
def test_lines_without_entries(spark, texts):
    got = deduped(spark, list(enumerate(texts)))
    assert [r["text"] for r in sorted(got)] == texts


def test_lines_of_shared_and_null_ids_and_repeated_rows(spark):
    a, b = " ".join(prose(12, 1)), " ".join(prose(12, 2))
    got = deduped(spark, [(None, a), (None, f"{a}\n{b}"), (None, a), (3, b), (3, f"x\n{b}"), (4, f"only\n\n{prose(9, 3)}"), (4, f"only\n\n{prose(9, 3)}")], counts=True)
    kept = [line for r in got for line in (r["text"] or "").split("\n") if line.strip()]
    assert sorted(kept) == sorted([a, b, "x", "only", str(prose(9, 3))]) and len(got) == 7
    assert sum(r["n_lines"] for r in got) == 1 + 2 + 1 + 1 + 2 + 3 + 3 and sum(r["n_removed"] for r in got) == 6


def test_lines_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a b c", 7, "u", 5, True), (2, "a b c", 8, "v", 6, False)], "doc_id long, text string, _key int, `_gone` string, n_lines int, `x.y` boolean")
    got = {r["doc_id"]: r for r in lines.without_repeated_lines(rows).collect()}
    assert tuple(got[1]) == (1, "a b c", 7, "u", 5, True) and tuple(got[2]) == (2, "", 8, "v", 6, False)
    assert lines.without_repeated_lines(rows, counts=True).columns == ["doc_id", "text", "_key", "_gone", "x.y", "n_lines", "n_removed"]


def test_many_repeated_lines_in_one_text(spark):
    n = 100_000
    began = time.time()
    got = deduped(spark, [(1, "\n".join(["the same line again"] * n)), (2, "a line of its own")], counts=True)
    assert {(r["doc_id"], r["text"], r["n_removed"]) for r in got} == {(1, "the same line again", n - 1), (2, "a line of its own", 0)}
    assert time.time() - began < 60


def test_sets_of_lines():
    data = np.frombuffer(b"b a b\n\nc\na", np.uint8)
    text, cut, h, _ = lines.line_sets(data, np.array([0, 8, len(data)]))
    assert text.tolist() == [0, 0, 0, 1, 1] and np.diff(cut).tolist() == [2, 0, 1, 0, 1] and len(set(h.tolist())) == 3


def test_alike_lines_of_one_word_are_joined_without_all_pairs(spark):
    rows = [(i, " ".join([*prose(30, 5), f"tail{i}"])) for i in range(3000)]
    got = {r["doc_id"]: r["text"] for r in deduped(spark, rows)}
    assert got[0] == rows[0][1] and not any(got[i] for i in range(1, 3000))


def test_one_of_each_goes_by_id_and_text(spark):
    a, b = " ".join(prose(60, 1)), " ".join(prose(60, 2))
    c = " ".join(prose(60, 3))
    rows = [(6, a), (7, a), (7, b), (None, b), (None, c), (None, c), (8, c), (9, None), (9, ""), (10, " ".join(prose(60, 4))), (10, " ".join(prose(60, 4)))]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, _key int, `_gone` double")
    got = grams.one_of_each(frame)
    assert got.columns == frame.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(6, a), (7, b), (8, c), (9, None), (9, ""), (10, rows[9][1])])


def test_mix_parts_equal_rows_and_keeps_columns(spark):
    rows = [(1, "one two three four", "a", 3, "x", 1.0)] * 40 + [(2, "five", "b", 4, "y", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __size int, _copies string, size double")
    got = mixing.mix_sources(docs).collect()
    target = next(r["target"] for r in got if r["source"] == "a")
    assert abs(sum(r["taken"] for r in got if r["source"] == "a") - target) <= 2
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(rows) and out.count() == sum(r["copies"] for r in got)
    smaller = mixing.mix_sources(docs, share=0.7).groupBy("doc_id").sum("taken").collect()
    assert sum(r[1] for r in smaller) <= sum(r["taken"] for r in got)


def test_a_larger_budget_takes_the_same_rows_and_more(spark):
    docs = spark.createDataFrame([(i, " ".join(prose(1 + i % 9, i)), "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    takes = [{r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs, share=s).collect()} for s in (0.3, 0.6, 0.9, 1.4)]
    assert all(a[i] <= b[i] for a, b in zip(takes, takes[1:]) for i in a)


def test_vectors_that_share_an_id(spark):
    v = np.random.default_rng(2).standard_normal(16)
    rows = [(1, v.tolist()), (1, (v + 0.01).tolist()), (2, (v - 0.01).tolist()), (3, (-v).tolist())]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_recall_of_banding_at_the_threshold():
    bands, rows = grams.plan_bands()
    r, met, asked = np.random.default_rng(7), 0, 0
    for _ in range(400):
        both = r.integers(0, 2**63, 80).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, r.integers(0, 2**63, 10).astype(np.uint64)])) for _ in range(2))  # a similarity of 0.8
        met += (grams.band_keys(a, bands, rows) == grams.band_keys(b, bands, rows)).any()
        asked += 1
    assert met / asked >= 0.985


def test_recall_of_vectors_at_the_threshold(spark):
    r = np.random.default_rng(8)
    base = r.standard_normal((300, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = r.standard_normal(base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    near = 0.9501 * base + np.sqrt(1 - 0.9501**2) * away
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([base, near]))]
    got = {x["vec_id"]: x["n_links"] for x in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[i] >= 1 for i in range(300)) >= 0.97 * 300


def test_subset_sums_save_cuts(spark):
    """Windows filled from the longest item on, without the subset sum, cut more documents."""
    r = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(prose(r.randint(1, 120), i))) for i in range(1500)], "doc_id long, text string").coalesce(1)
    pieces = packing.pack_documents(docs, TOKENIZER, capacity=256).collect()
    tokens = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert sum(p["length"] for p in pieces) == sum(tokens.values())
    least = sum(-(-n // 256) for n in tokens.values())
    streamed, at = 0, 0
    for i in sorted(tokens):  # one after another, as a plain packer cuts them
        streamed += (at % 256 + tokens[i] - 1) // 256 + 1
        at += tokens[i]
    assert len(pieces) - least < 0.1 * (streamed - least)


def test_a_very_long_text(spark):
    text = " ".join(prose(200_000, 1))
    docs = spark.createDataFrame([(1, text), (2, f"{text} end"), (3, "short")], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in grams.near_documents(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(docs).collect()} == {1: text, 2: "", 3: "short"}
    by = defaultdict(int)
    for p in packing.pack_documents(docs, TOKENIZER).collect():
        by[p["doc_id"]] += p["length"]
        assert p["length"] <= 4096
    assert by[1] > 200_000 and by[3] == 2
