"""Hard negatives, resampling and the merge-type encoding against brute-force versions, and their odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import merges, negatives, resample

MODEL = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
SHAPE = "vec_id long, label int, embedding array<double>, a string, block int, score string"


def brute_negatives(rows: list[tuple], positives=5, k=5) -> list[tuple]:
    use = [(i, g, [math.floor(256 * x) for x in v]) for i, g, v, *_ in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, g, v in use:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, h) for j, h, w in use if j != i and len(w) == len(v))
        best = [(j, -s) for s, j, h in scored if h == g][:positives]
        for p, s in best:
            found = [(j, -t) for t, j, h in scored if h != g and 80 * s <= -100 * t <= 100 * s][:k]
            out += [(i, p, n, j, s, t) for n, (j, t) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    base = r.standard_normal((12, 8))
    rows = [(i, int(r.integers(0, 3)), (base[i % 12] + 0.2 * r.standard_normal(8)).tolist()) for i in range(1500)]
    rows += [(2000 + i, i % 2, rows[100][2]) for i in range(40)]  # one vector again and again
    rows += [(None, 1, rows[0][2]), (3000, None, rows[0][2]), (3100, 1, None), (3200, 1, [1.0, None]), (3300, 1, [math.nan] * 8), (3400, 1, [math.inf] * 8), (3500, 1, []), (3501, 2, []), (3600, 1, [1.0, 2.0]), (3601, 2, [1.0, 2.0]), (3602, 1, [1.0, 2.5])]
    return [(*r, "x", 1, "y") for r in rows]


def test_negatives_are_those_of_a_full_sort(spark, vectors, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST", 100)  # 16 blocks
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    df = spark.createDataFrame(vectors, SHAPE).repartition(4)
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(vectors) != []
    assert negatives.hard_negatives(df.where("false"), F.lit(True)).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_negatives_of_rows_that_share_an_id(spark):
    one = [(100, 1, [1.0, 0.0]), (100, 1, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (2, 2, [0.9, 0.1]), (2, 2, [0.9, 0.1])]
    got = negatives.hard_negatives(spark.createDataFrame(one, "vec_id long, label int, embedding array<double>"), F.col("vec_id") == 100).collect()
    assert sorted(map(tuple, got)) == sorted([(100, 1, n, 2, 256 * 256, 256 * 230) for n in (1, 2)] * 2)


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**20 + 1, 2.0], [-1.0, 5.0]])
    assert negatives.scores(a, b).tolist() == [[(2**40 + 1) * (2**20 + 1) + 6, -(2**40) - 1 + 15]]
    with pytest.raises(OverflowError):
        negatives.scores(np.array([[2.0**60]]), np.array([[2.0**60]]))


def runs(text: str | None) -> tuple[int, list[bytes]]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]).encode() for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(docs: list[tuple], target: list[str | None], share=(5, 100), least=20, buckets=10_000) -> dict:
    own, aim = (Counter(zlib.crc32(f) % buckets for t in texts for f in runs(t)[1]) for texts in ([d[1] for d in docs], target))
    s, t = sum(own.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in own}
    out = {}
    for i, text, *_ in docs:
        n, f = runs(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f)
        out[i] = [n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
    fit = sorted((-x[3], i is None, i or 0, i) for i, x in out.items() if x[0] >= least)
    ranks = {x[-1]: n for n, x in enumerate(fit[: share[0] * len(fit) // share[1]], 1)}
    return {i: (*x, ranks.get(i)) for i, x in out.items()}


def test_resample_is_what_counting_and_sorting_give(spark, monkeypatch):
    r = random.Random(5)
    words = ["Alpha", "beta", "γάμμα", "x" * 300, "d1", "e_f", "ß", "the", "z" * 70, "\x00q", "９"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60))) if i % 9 else None, 1, "x") for i in range(600)]
    docs += [(None, "one null id " * 9, 1, "x"), (601, "", 1, "x"), (602, "!!", 1, "x"), (603, " ".join(r.choice(words[:4]) for _ in range(4000)), 1, "x")]
    target = ["beta the d1", None, "", "the the the ß"]
    a = spark.createDataFrame(docs, "doc_id long, text string, score int, weight string").repartition(4)
    b = spark.createDataFrame([(t,) for t in target], "text string")
    for share in ((5, 100), (60, 100)):
        want = brute_resample(docs, target, share)
        for together in (2_000_000, 700):  # in one piece, and in windows of a text
            monkeypatch.setattr(resample, "TOGETHER", together)
            got = {x["doc_id"]: tuple(x)[1:] for x in resample.resample(a, b, share=share).collect()}
            assert got == want
    none = a.where("false")
    assert resample.resample(none, b).count() == 0 and resample.resample(a, b.where("false")).count() == len(docs)


def test_resample_numbers_repeated_rows_and_ties(spark):
    docs = [(7, "word " * 30)] * 300 + [(8, "word " * 30)] * 20
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("word",)], "text string"), share=(50, 100)).collect()
    assert len(got) == 320 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 161)) and len({r["score"] for r in got}) == 2


def test_checksums_of_long_words_and_joins():
    words = [b"", b"a", b"bcd", b"e" * 65, b"f" * 1000, b"g" * 300_000]
    data, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    ends = np.cumsum(size)
    c = resample.checksums(data, ends - size, ends)
    assert c.tolist() == [zlib.crc32(w) for w in words]
    for w in words:
        a = np.full(len(words), zlib.crc32(w), np.uint32)
        assert resample.joined(a, c, size).tolist() == [zlib.crc32(w + x) for x in words]


@pytest.fixture(scope="module")
def own():
    return merges.Encoder(MODEL)


PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "▁", "é", "中", "🎉", "ﬁ", "ing", "<s>", "<0x0A>", "\x00", "\x7f", "​", "   ", ".", "&&&", "th", "\xa0", "ß", "日本", "un", "able", "▁▁", "0", "\r\n"]


def test_encoding_is_the_librarys(own):
    r = random.Random(2)
    pieces = list(own.text.values())
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(8000)]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(0, 6))).replace("▁", " ") for _ in range(8000)]
    texts += ["ab" * 5000 + " " * 7000 + "x" * 9000 + "abcd" * 3000 + "\n" * 5000 + "🎉" * 5000]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == own.library.encode(t, add_bos=True, add_eos=True), repr(t[:200])


def test_agreement_is_what_merging_both_gives(own):
    r = random.Random(3)
    pieces = list(own.text)
    for _ in range(3000):
        a, b = r.choice(pieces), r.choice(pieces)
        parts = list(own.text[a] + own.text[b])
        while True:
            found = [(own.score[x + y], -i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in own.score]
            if not found:
                break
            at = -max(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert own.agree(a, b) == (parts == [own.text[a], own.text[b]])


def test_memory_of_words_is_bounded(own, monkeypatch):
    monkeypatch.setattr(merges, "WORDS", 50)
    monkeypatch.setattr(merges, "PAIRS", 50)
    monkeypatch.setattr(merges, "CHARACTERS", 500)
    r = random.Random(4)
    text = "".join(r.choice(PARTS) for _ in range(20_000))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == own.library.encode(text, add_bos=True, add_eos=True)
    assert len(own.words) <= 51 and len(own.pairs) <= 51


def test_encode_keeps_all_rows(spark, own):
    rows = [(1, "Hello  world\n", 1), (None, None, 2), (3, "", 3), (3, "", 3), (4, "é中 " * 50_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = merges.encode(docs, MODEL).collect()
    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got) == Counter((i, own.encode(t or ""), own.library.decode(own.library.encode(t or ""))) for i, t, _ in rows)
    assert merges.encode(docs.where("false"), MODEL).count() == 0
    named = spark.createDataFrame([("k", "a b")], "`d.id` string, `T x` string")
    assert merges.encode(named, MODEL, id_col="d.id", text_col="T x", decoded=False).first()["decoded"] is None
