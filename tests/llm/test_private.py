"""Added spans against other data of the same shape: only the words and signs around tell them apart."""

from __future__ import annotations

import random

import pytest

from millrace.llm import pii

R = random.Random(11)
SOME = lambda of, n: "".join(R.choice(of) for _ in range(n))
FILLER = "green water flows under old bridges while people walk along quiet streets with their friends during warm evenings of late summer".split()
SURNAMES = "Smith Okafor Lindqvist Nakamura Rossi Novak Haddad Kowalski Yilmaz Silva".split()


def fill() -> str:
    return " ".join(R.choice(FILLER) for _ in range(R.randint(4, 10)))


def digits(n: int) -> str:
    return SOME("23456789", 1) + SOME("0123456789", n - 1)


#: Of each kind: a value, what stands before private ones, and what before others of the same shape.
MAKE = {
    "ssn": (lambda: f"{R.randint(100, 600)}-{R.randint(10, 99)}-{R.randint(1000, 9999)}", ["ssn ", "social security ", "taxpayer: "], ["part ", "model ", "bridge "]),
    "secret": (lambda: SOME("0123456789abcdef", 38) + "1a", ["api token ", "password=", 'secret: "'], ["commit ", "sha256 ", "build "]),
    "local_phone": (lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", ["call ", "tel: ", "phone "], ["order ", "item ", "invoice "]),
}


@pytest.mark.parametrize("share", [0.17, 0.5])
def test_spans_of_one_shape_are_told_apart(spark, share):
    rows, want = [], {}
    for kind, (value, private, other) in MAKE.items():
        for k in range(300):
            mine = k < 300 * share
            head, v = f"{fill()} {R.choice(private if mine else other)}", value()
            rows.append((len(rows), f"{head}{v}{chr(34) if head.endswith(chr(34)) else ''} {fill()}"))
            want[len(rows) - 1] = (kind, mine, (kind, len(head), len(head) + len(v)))
    R.shuffle(rows)
    got = {x["doc_id"]: {tuple(s) for s in x["added_spans"]} for x in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in MAKE:
        mine = [i for i, w in want.items() if w[0] == kind and w[1]]
        taken = [i for i, w in want.items() if w[0] == kind and w[2] in got[i]]
        right = [i for i in taken if want[i][1]]
        assert len(right) >= 0.9 * len(mine) and len(right) >= 0.9 * len(taken), (kind, len(mine), len(taken), len(right))


def test_names_of_any_length():
    for name in ("Maria Garcia Lopez Perez Santos", "Anna Maria van der Berg zu Hohenfels", "Jean-Luc Picard"):
        assert [(k, f"so said Mrs. {name} yesterday"[a:b]) for (k, a, b), _, _ in pii.candidates(f"so said Mrs. {name} yesterday", [])] == [("name", name)]
    text = "Mr. Karl von der Heide met Maria Garcia Lopez Perez Santos and Frau Özil of the city, not Maria alone"
    assert [text[a:b] for (_, a, b), _, _ in pii.candidates(text, [])] == ["Karl von der Heide", "Maria Garcia Lopez Perez Santos", "Özil"]
    assert list(pii.candidates("Mr. " + "Karl " * 50_000, []))[0][0] == ("name", 4, 4 + 5 * 50_000 - 1)


def test_paths_are_no_secrets(spark):
    paths = [(i, f"{fill()} see /usr/local/lib/python3/site-packages/numpy{i} {fill()}") for i in range(40)]
    keys = [(100 + i, f"{fill()} token = {SOME('0123456789abcdef', 40)} {fill()}") for i in range(40)]
    got = {x["doc_id"]: len(x["added_spans"]) for x in pii.find_private(spark.createDataFrame(paths + keys, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(40)) == 0 and sum(got[100 + i] for i in range(40)) >= 38
