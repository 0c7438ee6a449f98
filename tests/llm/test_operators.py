"""Edge cases of the training-data operators, and small brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import embeddings, grams, html, katz, langid, lines, media, mixing, packing, pii
from millrace.llm.common import word_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h string"
TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = words(6000, 1)
    near = long.replace(" ", "  ", 3).rsplit(" ", 5)[0]
    base = [
        (1, "The cat sat on the mat.\nA line that comes again and again here\n\nEnd", "en", "a"),
        (2, "A line that comes again and again here\nA line that comes again and again there", "en", "a"),
        (3, None, "en", "b"), (4, "", None, None), (5, " \n\t ", "en", "b"), (6, long, "de", "b"), (7, near, "de", None),
        (8, long, "de", "c"), (9, long, "de", "c"), (9, long, "de", "c"), (None, "no id at all", "en", "c"), (10, "a@b.co 10.0.0.1 +1 (555) 123-4567", None, "d"), (11, "12 34 !!", "en", "é"),
    ]
    return [(i, t, g, s, 1, 7, "x") for i, t, g, s in base]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def count(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_word_count(docs, rows):
    got = docs.select("text", word_count("text").alias("n")).collect()
    assert all(r["n"] == count(r["text"]) for r in got)


def test_mixing(docs, none, rows):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and all(r["size"] == count(r["text"]) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in got)
    total, target = sum(r["size"] for r in got), {r["source"]: r["target"] for r in got}
    assert sum(target.values()) == pytest.approx(1.5 * total)
    for s, aim in target.items():  # the two equal rows of document 9 are one source's boundary and can differ
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - aim) <= max(r["size"] for r in own) / 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in got)


def test_targets_fill_by_weight():
    got = mixing.targets([10, 100, 1000], [3, 1, 2])
    assert got[0] == 20 and sum(got) == pytest.approx(1665) and got[1] <= 200


def test_fill_is_the_best_subset_sum():
    r = random.Random(4)
    for _ in range(200):
        counts = Counter(r.randint(1, 12) for _ in range(r.randint(0, 6)))
        room, sums = r.randint(1, 30), {0}
        for n, k in counts.items():
            sums = {s + n * i for s in sums for i in range(k + 1) if s + n * i <= room}
        got = packing.fill(sorted(counts, reverse=True), counts, room)
        assert sum(n * k for n, k in got.items()) == max(sums) and all(k <= counts[n] for n, k in got.items())


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    got = packing.pack_documents(docs, TOKENIZER, capacity=256).collect()
    ids = Counter(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, x, *_ in rows)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        n = sum(p["length"] for p in pieces)
        assert [p["offset"] for p in pieces] == [sum(q["length"] for q in pieces[:i]) for i in range(len(pieces))] and n <= 256 and n & (n - 1) == 0
    assert sum(r["length"] for r in got) == sum(len(k) // 4 * v for k, v in ids.items())
    one = sorted((r for r in got if r["doc_id"] == 6), key=lambda r: r["start"])
    assert b"".join(r["ids"] for r in one) in ids
    assert packing.pack_documents(none, TOKENIZER).count() == 0


def test_words_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    t, own, r = Tokenizer.from_file(TOKENIZER), packing.WordIds(TOKENIZER), random.Random(3)
    parts = ["a", "B", "é.", "é", " ", "\n", " ", "'s", "'", "1", ",", ".", "<|endoftext|>", "<|ENDOFTEXT|>", "中", "İ", "\x1c", "-", "×,"]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 10)))
        raw = np.frombuffer(x.encode(), np.uint8)
        assert own.encode(raw, np.array([0, len(raw)]))[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_rendering():
    source = "<head><title>no</title></head><p>x<p>y <b>z</b><ul><li>a<li>b<ol start=4><li>c</ol></ul><table><tr><td>a<td>bbb<tr><td>cccc<td>d</table><p hidden>no</p><div style='display:none'>no</div>1 &lt; 2<br>end<script>no</script>"
    assert html.render(source) == "x\n\ny z\n\n- a\n- b\n  4. c\n\na     bbb\ncccc  d\n\n1 < 2\nend"
    assert html.render("") == "" and html.render("<div>" * 5000 + "deep") == "deep" and html.render("a < b <unclosed 'x") != ""


def test_a_head_ends_where_the_body_begins():
    for end in ("<p>", "<div>", "<b>", "<body><p>", "</head><p>", "", "<img><p>", "<noscript><img></head><p>", "<noscript><link><body><p>"):
        assert html.render(f"<html><head><title>t</title><meta><style>s</style>{end}all text") == "all text"
        assert [i["text"] for i in html.interleaved(f"<head><script>s</script><title>t</title>{end}all<p>text")] == ["all text"]
    assert html.render("<head> <title>t</title>\n<link>\n</head>\n<body>x") == "x"


def test_empty_foreign_elements():
    for source in ("<p><svg/>Text</p>", "<svg width='1' />Text", "<svg><style/><g><path/></g><title/></svg>Text", "<svg><title>no</svg>Text", "<svg><svg/>no</svg>Text", "<svg>no<p>Text", "<div><svg>no</div>Text", "<svg><desc><p>no<p>no</desc>no</svg>Text", "<svg><style>a{}</style><script>no</script></svg>Text", "<svg a=b/>no</svg>Text"):
        assert html.render(source) == "Text"
        assert [i["text"] for i in html.interleaved(source)] == ["Text"]
    assert html.render("<math/>a<math><mi/>b<p>c") == "ab\n\nc" and html.render("<div hidden/>no</div>Text") == "Text"


def test_interleaved_implies_the_same_tags():
    got = html.interleaved("<p hidden>no<p>one<ul><li style='display:none'>no<li>two</ul><video src=v>three</video><table><tr><td>a<td>b</table>")
    assert [i["text"] or i["ref"] for i in got] == ["one two", "v", "three a b"]


def test_rendering_of_visibility_breaks_and_spans():
    assert html.render("<p aria-hidden=true>seen<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>") == "seen\n\nyes"
    assert html.render("a<br>b<br><br>c<br><br><br>d") == "a\nb\n\nc\n\n\nd"
    assert html.render("<table><tr><th colspan=2>head<th>x<tr><td>aaaa<td>bbbb<td>c</table>") == "head        x\naaaa  bbbb  c"
    assert html.render("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert html.render("<table><tr><td colspan=2>a long heading<td>z<tr><td>1<td>2<td>3</table>") == "a long heading  z\n1  2            3"


def test_rendering_takes_time_and_room_in_proportion():
    n = 30_000
    long = "w" * 200_000
    pages = ["<a" * n, "<div>" * n + "end", "<a \">\"" * n, "<p><button>" + "<div>" * n, "<ul><li>" * 3000 + "end", f"<table><tr><td>{long}<td>x" + "<tr><td>a<td>b" * 400 + "</table>", "<a " + "=" * n + "/>end", "<table><tr><td>" * 2000 + "end", "<table><tr>" + "<td>abcdefgh" * 900 + "<tr><td colspan=899><td>x" * 900 + "</table>", "<!--" * n, "<b><i>" * n + "</b>" * n]
    for page in pages:
        began = time.process_time()
        got = html.render(page)
        html.interleaved(page)
        assert time.process_time() - began < 5 and len(got) < 12 * len(page) + 1000, page[:40]
    assert sum(x.count("w") for x in html.render(pages[5]).split()) == len(long)


class Plain(HTMLParser):
    """Visible words of well-formed pages, without any layout."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "img":
            self.words += (dict(attrs).get("alt") or "").split() if not self.hidden else []
        if tag not in html.VOID and (self.hidden or tag in html.UNSEEN or "hidden" in dict(attrs) or "none" in (dict(attrs).get("style") or "")):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        self.words += data.split() if not self.hidden else []


def test_pages_show_the_words_of_a_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    got = {r["page_id"]: r["text"] for r in html.render_pages(pages).collect()}
    for page, source in pages.collect():
        plain = Plain()
        plain.feed(source)
        assert re.sub(r"(?m)^\s*(-|[0-9]+\.) ", "", got[page]).split() == plain.words


def test_nested_figures():
    got = html.interleaved("<figure><img src=a><figure><img src=b><figcaption>inner</figcaption></figure><img src=c><figcaption>outer</figcaption></figure><figure>only<figcaption>words</figcaption></figure>")
    assert [(i["ref"] or i["text"], i["caption"]) for i in got] == [("a", "outer"), ("b", "inner"), ("c", "outer"), ("only words", None)]


def test_render_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a", "z"), (2, None, "z"), (None, "", "z"), (1, "<p>a", "z")], "page_id long, html string, text string")
    assert sorted(map(tuple, html.render_pages(pages).collect()), key=str) == sorted([(1, "a"), (2, None), (None, ""), (1, "a")], key=str)
    assert html.render_pages(pages.limit(0)).count() == 0


def test_interleaved_order_and_captions():
    got = html.interleaved("<p>one<figure><img src=a alt=x><figcaption>cap</figcaption></figure>two<img src=b alt=y>")
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in got] == [("text", "one", None), ("image", "a", "cap"), ("text", "two", None), ("image", "b", "y")]
    assert [i["position"] for i in got] == [0, 1, 2, 3]


def test_media(docs, none, rows):
    for x in (b"", b"a", bytes(range(256)) * 9, b"\xff" * 576):
        assert media.decode(media.encode(media.padded(x))) == media.padded(x)
    with pytest.raises(ValueError):
        media.decode(media.encode(media.padded(b"a"))[:-20] + b"\0" * 20)
    got = media.text_media(docs).collect()
    assert len(got) == len(rows)
    def want(text: str | None) -> tuple:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        png = media.encode(payload)
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), media.features(payload)

    columns = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert Counter((r["doc_id"], *(r[c] for c in columns)) for r in got) == Counter((i, *want(t)) for i, t, *_ in rows)
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["position"], by[1]["n_items"], by[1]["caption"]) == (1, 3, "document 1") and (by[3]["position"], by[3]["n_items"]) == (0, 1)
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (6, 8, 9)}) == 1
    assert media.text_media(none).count() == 0


def test_interleaved_pages_with_stored_media(spark, tmp_path):
    stored = media.store(spark.createDataFrame([(b"one",), (b"two",), (b"two",), (None,)], "p binary"), str(tmp_path / "media"))
    ref = lambda x: "sha256:" + hashlib.sha256(media.padded(x)).hexdigest()
    page = f"<h1>Title</h1><figure><img src='{ref(b'one')}'><figcaption>first</figcaption></figure><p>between<img src='{ref(b'two')}' alt=second><p>end<img src=gone.png>"
    pages = spark.createDataFrame([(1, page), (2, "<p>words alone"), (3, None)], "page_id long, html string")
    items = media.sequences(pages).select("doc_id", F.explode_outer("items").alias("i")).where("i IS NOT NULL").select("doc_id", "i.*")
    docs = {r["doc_id"]: r["items"] for r in media.documents_of(media.resolve(items, media.described(stored).select("digest", "payload_bytes"))).collect()}
    assert [(i["text"] or i["ref"][:7], i["caption"], i["payload_bytes"]) for i in docs[1]] == [("Title", None, None), ("sha256:", "first", 576), ("between", None, None), ("sha256:", "second", 576), ("end", None, None), ("gone.pn", None, None)]
    assert [i["position"] for i in docs[1]] == list(range(6)) and set(docs) == {1, 2}
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert all(r["text"] or r["ref"] for r in media.sequences(real).select(F.explode("items").alias("i")).select("i.*").collect())


def katz_brute_force(train: list[list[bytes]]):
    """The probability of a word after another, or after b" " at the start, straight from the definitions."""
    uni, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([b" ", *t], t, strict=False))
    of = lambda c: np.array([sum(v == r for v in c.values()) for r in range(1, 7)])
    du, dp, n = katz.good_turing(of(uni)), katz.good_turing(of(pairs)), sum(uni.values())
    cut = lambda c, d: c if c > 5 else c * d[c - 1] if c else 0.0
    total = n + all(c > 5 for c in uni.values())
    unknown = 1 - sum(cut(c, du) for c in uni.values()) / total
    word = lambda w: cut(uni[w], du) / total if uni[w] else unknown
    after: dict = {}
    for (a, b), c in pairs.items():
        after.setdefault(a, {})[b] = c

    def p(a, b):
        if a not in after:
            return word(b)
        own = after[a]
        whole = sum(own.values()) + all(c > 5 for c in own.values())
        if b in own:
            return cut(own[b], dp) / whole
        return (1 - sum(cut(c, dp) for c in own.values()) / whole) / (1 - sum(map(word, own))) * word(b)

    return p, uni, n


@pytest.mark.parametrize("times", [1, 6])
def test_katz_is_normalised_and_exact(spark, docs, none, rows, times):
    every = docs
    for _ in range(times - 1):  # with six of each, no count is discounted
        every = every.unionByName(docs)
    got = katz.katz_scores(every, F.col("doc_id") % 3 != 1).collect()
    token = lambda x: [*(x or "").encode().lower().split(), b"\n"]
    train = [token(x) for i, x, *_ in rows if i is not None and i % 3 != 1] * times
    p, uni, n = katz_brute_force(train)
    for a in (b" ", b"the", train[0][0], b"never met"):
        assert sum(p(a, b) for b in uni) + p(a, b"never met") == pytest.approx(1)
    base = lambda t: sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (len(uni) + 1))) for w in t)
    want = sorted((str(i), round(sum(math.log10(p(a, b)) for a, b in zip([b" ", *token(x)], token(x), strict=False)), 5), base(token(x)), len(token(x)), sum(uni[w] > 0 for w in token(x)), i is None or i % 3 == 1) for i, x, *_ in rows * times)
    got_rows = sorted((str(r["doc_id"]), round(r["score"], 5), r["base_score"], r["n_tokens"], r["n_known"], r["held_out"]) for r in got)
    assert got_rows == [(i, pytest.approx(s, abs=2e-5), pytest.approx(b, abs=1e-6), k, m, h) for i, s, b, k, m, h in want]
    assert all(r["train_tokens"] == n for r in got) and katz.katz_scores(none, F.lit(True)).count() == 0


def test_katz_without_training_rows(docs, rows):
    got = katz.katz_scores(docs, F.lit(False)).collect()
    assert len(got) == len(rows) and all(r["score"] == 0 and r["train_tokens"] == r["n_known"] == 0 and r["held_out"] for r in got)


def test_near_documents(docs, none, rows):
    got = {r["doc_id"]: r for r in grams.near_documents(docs).collect()}
    assert {got[i]["class_id"] for i in (6, 7, 8, 9)} == {6} and got[6]["n_links"] == 4
    assert all(got[i]["n_links"] == 0 and got[i]["class_id"] == i for i in (1, 2, 3, 4, 5, 10, 11, None))
    assert {r["doc_id"] for r in grams.one_of_each(docs).collect()} == {1, 2, 3, 4, 5, 6, 10, 11, None}
    assert grams.near_documents(none).count() == 0 and grams.one_of_each(none).count() == 0


def test_lines(docs, none, rows):
    got = lines.without_repeated_lines(docs, counts=True).collect()
    text = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and text[1] == rows[0][1] and text[2] == "A line that comes again and again there" and text[3] is None and text[4] == "" and text[5] == " \n\t "
    assert text[7] == text[8] == "" and text[6] == rows[5][1]
    assert lines.without_repeated_lines(none).count() == 0


def test_lines_against_all_pairs(spark):
    r = random.Random(6)
    texts = ["\n".join(" ".join(r.choice("a b c d e f g h i j k l".split()) for _ in range(r.randint(0, 9))) for _ in range(6)) for _ in range(40)]
    got = {x["doc_id"]: x["text"] for x in lines.without_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    before: list[set] = []
    for i, t in enumerate(texts):
        kept = []
        for line in t.split("\n"):
            s = set(line.split())
            if not s or not any(len(s & b) / len(s | b) >= 0.8 for b in before):
                kept.append(line)
            before.append(s) if s else None
        assert got[i] == "\n".join(kept)


def test_language(spark, none):
    en = ["the cat and the dog went to the house with their friends " + words(2, i) for i in range(40)]
    de = ["der hund und die katze gingen mit ihren freunden nach hause " + words(2, i) for i in range(40)]
    data = spark.createDataFrame([(i, x, "en") for i, x in enumerate(en)] + [(100 + i, x, "de") for i, x in enumerate(de)] + [(200, "unlabelled", None)], "doc_id long, text string, lang string")
    model = langid.fit(data)
    ask = spark.createDataFrame([(1, "the dog and the cat"), (2, "der hund und die katze"), (3, None), (4, "123 !?"), (5, ""), (6, "中文字符测试" * 30)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(ask, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "und"]
    assert [got[i]["rejected"] for i in range(1, 7)] == [False, False, True, True, True, True]
    assert {r["doc_id"] for r in langid.accepted(model, ask).collect()} == {1, 2}
    assert langid.identify(none, model).count() == 0 and {r["lang_pred"] for r in langid.identify(ask, langid.fit(none)).collect()} == {"und"}


def test_long_texts_count_as_in_one_piece(monkeypatch):
    r = random.Random(5)
    for k in range(60):
        t = "".join(r.choice("ab  é1Z\n") for _ in range(r.randint(15, 90)))
        whole = langid.vectors([t, "x"])
        monkeypatch.setattr(langid, "LONG_TEXT", r.randint(2, 14))
        got = langid.vectors([t, "x"])
        assert (whole[0] == got[0]).all() and (whole[1] == got[1]).all()
        monkeypatch.undo()


def test_language_sample_counts_distinct_texts(spark, monkeypatch):
    data = [(words(9, i), "en") for i in range(30)] + [("a text met again", "en")] * 3000 + [(words(9, 100 + i), "de") for i in range(300)] + [(words(9, 500 + i), "fr") for i in (1, 2, 3, 3)]
    data = spark.createDataFrame(data, "text string, lang string")
    monkeypatch.setattr(langid, "Model", lambda texts, languages: (texts, languages))
    texts, languages = langid.fit(data, per_language=10)
    assert Counter(languages) == {"en": 10, "de": 10, "fr": 3} and len(set(texts)) == 23
    assert Counter(langid.fit(data, per_language=50)[1]) == {"en": 31, "de": 50, "fr": 3}


def test_every_label_and_long_texts_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    monkeypatch.setattr(langid, "PER_LANGUAGE", 4)
    data = spark.createDataFrame([(words(9, 10 * i + k), f"l{i}") for i in range(6) for k in range(5 - i % 2)], "text string, lang string")
    assert langid.fit(data).languages == [f"l{i}" for i in range(6)]
    text = words(9000, 7)
    long = spark.createDataFrame([(text, "en"), ("kurz und gut", "de")], "text string, lang string")
    assert langid.fit(long).languages == ["de", "en"]
    monkeypatch.setattr(langid, "Model", lambda texts, languages: dict(zip(languages, texts, strict=True)))
    got = langid.fit(long, sample_chars=1000)
    step = (len(text) - 100) / 9
    assert got["de"] == "kurz und gut" and got["en"] == " ".join(text[int(i * step) :][:100] for i in range(10)) and got["en"].endswith(text[-100:])


def test_private_data(docs, none):
    found = pii.digest_columns(pii.find_private(docs)).collect()
    by = {r["doc_id"]: r for r in found}
    assert (by[10]["n_email"], by[10]["n_ip"], by[10]["n_phone"]) == (1, 1, 1) and by[3]["spans"] == ""
    assert pii.find_private(none).count() == 0
    assert pii.masked("mail a@b.co now", [("email", 5, 11)]) == "mail [email] now"


def _iban(country: str, account: str) -> str:
    raw = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{country}{98 - int(raw) % 97:02d}{account}"


def test_added_spans_of_every_kind(spark):
    r = random.Random(9)
    some = lambda of, n: "".join(r.choice(of) for _ in range(n))
    filler = lambda: " ".join(some("abcdefghij", r.randint(2, 8)) for _ in range(8))
    make = {
        "iban": lambda: (_iban("DE", some("0123456789", 18)), ["iban ", "account: "]),
        "ssn": lambda: (f"{r.randint(100, 600)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", ["ssn ", "social security "]),
        "local_phone": lambda: (f"({some('23456789', 3)}) {some('23456789', 3)}-{some('0123456789', 4)}", ["call ", "tel: "]),
        "secret": lambda: (some("0123456789abcdef", 40) + "1a", ["token = ", "password="]),
        "name": lambda: (r.choice(["Müller", "Jean-Luc Picard", "Anna O’Neil", "José García"]), ["Mr. ", "Frau ", "Señora ", "Dr. "]),
    }
    rows, want = [], {}
    for kind, of in make.items():
        for k in range(60):
            value, before = of()
            head = f"{filler()} {r.choice(before)}"
            rows.append((len(rows), f"{head}{value} {filler()}"))
            want[len(rows) - 1] = (kind, len(head), len(head) + len(value))
    clean = len(rows)
    rows += [(clean + k, f"{filler()} isbn {some('0123456789', 13)} order {some('0123456789', 6)} {some('abcdef', 30)} {filler()}") for k in range(60)]
    got = {x["doc_id"]: [tuple(s) for s in x["added_spans"]] for x in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in make:
        mine = [i for i, w in want.items() if w[0] == kind]
        assert sum(want[i] in got[i] for i in mine) >= 0.9 * len(mine), kind
    assert sum(bool(got[i]) for i in range(clean, len(rows))) <= 3


def test_long_secrets_and_late_digits():
    text = f"key {'x' * 600}1 and {'a' * 60}7{'b' * 20} not {'c' * 40}"
    assert [s for s, _, _ in pii.candidates(text, [])] == [("secret", 4, 605), ("secret", 610, 691)]


def test_base_spans_are_the_patterns():
    def plain(t: str) -> list:
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            out += [("card", *m.span())] if 16 <= len(d) <= 19 and pii._luhn(d) else []
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    r = random.Random(2)
    for _ in range(5000):
        x = "".join(r.choice(["a", "@", "b", ".", "-", "1", "23", "+", " ", "(", ")", "_", "256", "0", "4111111111111111"]) for _ in range(r.randint(0, 24)))
        assert pii.base_spans(x) == plain(x)


def test_vectors(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((40, 16))
    data = [(i, v.tolist()) for i, v in enumerate(base)] + [(50 + i, (v + 0.02 * r.standard_normal(16)).tolist()) for i, v in enumerate(base[:10])] + [(70, base[3].tolist()), (71, base[3].tolist())]
    odd = [(80, None), (81, [0.0] * 16), (82, [float("nan")] * 16), (83, [None, 1.0]), (84, []), (None, base[3].tolist()), (85, [1.0, 2.0])]
    got = {x["vec_id"]: x for x in embeddings.near_duplicates(spark.createDataFrame(data + odd, "vec_id long, embedding array<double>")).collect()}
    x = np.array([v for _, v in data])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert [got[i]["n_links"] for i, _ in data] == want.tolist() and got[71]["component_id"] == 3 and not got[71]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i, _ in odd)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_many_lengths(spark):
    data = [(2 * d + i, [1.0] * d) if i else (2 * d, [1.0] * (d - 1) + [1.01]) for d in range(2, 123) for i in (0, 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(data) and all(x["n_links"] == 1 and x["component_id"] == x["vec_id"] // 2 * 2 for x in got)
