"""Layout of pages: nothing is cut, drawings' text, numbered lists, and words of all pages against a plain reader with lists of its own."""

from __future__ import annotations

import re
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from millrace.llm import html


def test_no_text_is_cut():
    url = "http://host/" + "a" * 305
    got = html.render(f"<table><tr><td>{url}</td><td>b</td></tr><tr><td>c<td>d</table>").split("\n")
    assert got == [f"{url}  b", "c" + " " * (len(url) + 1) + "d"]
    words = " ".join(f"w{i}" for i in range(500))
    got = html.render(f"<table><tr><td>{words}<td>z{url}</table>")
    assert got.split()[0] == "w0" and set(got.split()) == {*words.split(), f"z{url}"} and max(map(len, got.split("\n"))) <= html.WRAP + 2 + len(url) + 1


def test_tables_in_tables_keep_their_rows():
    for depth in (1, 14, 40):
        assert html.render("<table><tr><td>" * depth + "x<td>y" + "</table>" * depth) == "x  y"
    assert html.render("<table><tr><td>a<td><table><tr><td>b<td>c<tr><td>dd<td>e</table><tr><td>f<td>g</table>") == "a  b   c\n   dd  e\nf  g"


def test_what_cannot_be_aligned_in_proportion_is_all_there():
    cells = "".join(f"<tr><td>{i}<td>{'v' * (9000 if i == 7 else 1)}<td>u" for i in range(900))
    got = html.render(f"<table>{cells}</table>")
    assert len(got) <= (html.SPACES + 2) * (len(cells) + html.SMALL) and got.split("\n")[:2] == ["0  v  u", "1  v  u"]
    deep = html.render("<ul><li>w" * 3000)
    assert deep.count("w") == 3000 and len(deep) <= (html.SPACES + 1) * (9 * 3000 + html.SMALL) and deep.split("\n")[1] == "  - w"


@pytest.mark.parametrize("part", ["<table><tr><td>w", "<table><tr><td>w<td>v", "<ul><li>w", "<table><tr><td>x<td>" + "y" * 300, "<table><tr><td><table><tr><td>a<td>b</table>"])
def test_time_follows_the_page(part):
    took = []
    for n in (1500, 12_000):
        began = time.process_time()
        html.render(part * n)
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0] + 1


def test_text_of_drawings():
    assert html.render("a<svg>no<text>label</text><g><text>two <tspan>three</tspan></text></g><defs><text>no</text></defs><foreignObject><p>four</p></foreignObject></svg>b") == "a\nlabel\ntwo three\n\nfour\n\nb"
    assert [i["text"] for i in html.interleaved("a <svg><text>label</text>no</svg> b")] == ["a label b"]


def test_numbers_of_lists():
    assert html.render("<ol reversed><li>a<li>b<ol><li>q</ol><li>c</ol>") == "3. a\n2. b\n  1. q\n1. c"
    assert html.render("<ol><li value=5>x<li>y<li value=a>z</ol><ol reversed start=9><li>m<li>n</ol><ol reversed><li>o</ol>") == "5. x\n6. y\n7. z\n\n9. m\n8. n\n\n1. o"


class Reader(HTMLParser):
    """Words of a well-formed page, by lists that are written down here alone."""

    HIDDEN = {"head", "script", "style", "template", "title", "noscript"}
    EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__()
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "img" and a.get("alt") and not any(h for _, h in self.stack):
            self.out += a["alt"].split()
        if tag not in self.EMPTY:
            self.stack.append((tag, tag in self.HIDDEN or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "")))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(h for _, h in self.stack):
            self.out += data.split()


def test_words_of_all_pages():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    marks = re.compile(r"^\s*(?:-|-?[0-9]+\.)$")
    differ = 0
    for page in pages:
        reader = Reader()
        reader.feed(page)
        want, got = [w for w in reader.out if not marks.match(w)], [w for w in html.render(page).split() if not marks.match(w)]
        differ += sorted("".join(want)) != sorted("".join(got))
    assert len(pages) > 200 and differ == 0
