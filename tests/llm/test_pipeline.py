"""The pipeline's stages, one after another, against brute-force versions on a small table."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from millrace.llm.mixing import targets

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
EN = "the a house of green water and people walking through their old city with good weather while children play near river under bright morning light before school begins again every single day this long summer".split()
DE = "der die ein haus aus wasser und menschen gehen durch ihre alte stadt mit gutem wetter kinder spielen am fluss unter hellem morgenlicht bevor schule wieder beginnt jeden tag diesen langen sommer nicht schon immer auf dem weg".split()
JUNK = {900: None, 901: "", 902: "123 !?", 903: "中文字符测试" * 30}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def lines_of(words: list[str], n: int) -> str:
    return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    out = []
    for i in range(60):
        words = [r.choice(EN if i % 2 else DE) for _ in range(r.randint(60, 120))]
        out.append((i, lines_of(words, 10), "en" if i % 2 else "de", "abc"[i % 3] if i % 7 else None, 1))
        if i % 10 == 0:  # the same words broken into other lines, one of them changed
            out.append((200 + i, lines_of([*words[:30], "zebra", *words[31:]], 13), "de", "b", 1))
        if i % 15 == 0:  # a copy: all of its lines are repeated
            out.append((300 + i, out[-1][1], "de", "c", 1))
    return [*out, *[(i, t, None, "a", 1) for i, t in JUNK.items()]]


def without_repeats(docs: dict[int, str]) -> dict[int, str]:
    before, out = [], {}
    for i in sorted(docs):
        kept = []
        for line in docs[i].split("\n"):
            s = set(line.split())
            if not s or not any(len(s & b) / len(s | b) >= 0.8 for b in before):
                kept.append(line)
            before += [s] if s else []
        out[i] = "\n".join(kept)
    return out


def first_of_each(docs: dict[int, str]) -> set[int]:
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in docs.items() for w in [t.split()]}
    group = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for i in docs:
            for j in docs:
                if sets[i] and sets[j] and group[j] > group[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                    group[j], changed = group[i], True
    return {i for i in docs if group[i] == i}


def test_every_stage(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language"](spark, docs, str(tmp_path))
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    assert texts == {i: t for i, t, *_ in rows if i not in JUNK}
    two = stages["line_dedup"](spark, one, str(tmp_path))
    cut = {r["doc_id"]: r["text"] for r in two.collect()}
    all_cut = without_repeats(texts)
    assert cut == {i: t for i, t in all_cut.items() if t.split()} and any(not t for t in all_cut.values())
    three = stages["near_copies"](spark, two, str(tmp_path))
    left = {r["doc_id"]: r for r in three.collect()}
    assert set(left) == first_of_each(cut) and len(left) < len(cut)
    four = stages["mix"](spark, three, str(tmp_path))
    times = Counter(r["doc_id"] for r in four.collect())
    size = {i: len(r["text"].split()) for i, r in left.items()}
    by_source = defaultdict(list)
    for i, r in left.items():
        by_source[r["source"]].append(i)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[i] for i in by_source[s]) for s in order]
    for s, n, target in zip(order, sizes, targets(sizes, [[3, 1, 2][k % 3] for k in range(len(order))]), strict=True):
        assert abs(sum(times[i] * size[i] for i in by_source[s]) - target) <= max(size[i] for i in by_source[s])
        assert all(target // n <= times[i] <= min(2, target // n + 1) for i in by_source[s])
    for c in (one, two, three, four):
        assert c.columns == docs.columns

    t = Tokenizer.from_file(TOKENIZER)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {i: len(t.encode(left[i]["text"], add_special_tokens=False).ids) + 1 for i in times}
    assert {i: sum(p["length"] for p in packed if p["doc_id"] == i) for i in times} == {i: n * tokens[i] for i, n in times.items()}
    assert Counter(p["doc_id"] for p in packed if p["start"] == 0) == times and all(p["doc_tokens"] == tokens[p["doc_id"]] for p in packed)
    ends = lambda i: np.array([*t.encode(left[i]["text"], add_special_tokens=False).ids, 2], "<u4").tobytes()
    by_doc = defaultdict(list)
    for p in packed:
        by_doc[p["doc_id"]].append((p["start"], p["ids"]))
    for i, pieces in by_doc.items():  # a document's copies are cut alike or not; together their pieces give its ids as often as it was taken
        whole = ends(i)
        assert all(whole[4 * a : 4 * a + len(x)] == x for a, x in pieces) and sum(len(x) for _, x in pieces) == times[i] * len(whole)
    lengths = np.array([*Counter({s: sum(p["length"] for p in packed if p["sequence_id"] == s) for s in {p["sequence_id"] for p in packed}}).values()])
    assert ((lengths == 4096) | (lengths & (lengths - 1) == 0)).all()


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    r = random.Random(3)
    text = lambda k: lines_of(random.Random(k).choices(EN, k=80), 10)
    odd = [(None, text(1)), (None, text(1)), (None, text(2)), (5, text(3)), (5, text(3)), (5, text(4)), (6, None), (7, "")]
    rows = [(i, x, "en", None, 1, r.random(), "k", 3) for i, x in [*odd, *[(20 + k, text(9 + k)) for k in range(30)]]]
    spark.createDataFrame(rows, COLUMNS + ", _key double, `_gone` string, `a.b` int").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        kept.append(docs.collect())
    assert len(kept[0]) == 36 and len(kept[1]) == 34  # the null and the empty text went, then the rows that repeat one, id and text
    full = Counter((x["doc_id"], x["text"]) for x in kept[1] if x["text"])
    assert full[None, text(1)] == full[5, text(3)] == 1 and (None, text(2)) in full and (5, text(4)) in full
    assert len(kept[2]) == 34 and corpus_pipeline.run(spark, str(tmp_path)).count() >= len(kept[3])
