"""Personal data: exact patterns, and further spans by aggregated weak supervision.

Four base kinds are found by pattern and checked. For other private data, loose patterns
give candidate spans, and labelers of three sorts vote on each (+1, 0, -1): regex and shape,
gazetteers of words before the span, and its context. Expectation-maximisation over the
corpus-wide counts of vote patterns estimates every labeler's reliability for each kind; the
posteriors then train a classifier on features of the spans and on the words around them,
hashed, none of them a vote, that decides which candidates become spans. So of two spans of
one shape the one may be taken and the other left. Counts of (kind, votes, features) and of
(kind, votes, place, word's hash value) have a fixed number of keys, so what the driver
receives is bounded whatever the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, quoted, stash, tidy

BASE = ("email", "ip", "card", "phone")
#: Kinds that only the aggregated labelers decide; a local number is a phone without its plus.
ADDED = ("iban", "local_phone", "name", "secret", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run's first digit is the leftmost place to start, so the lookbehind changes no match; it keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Words that announce private data, words that announce other numbers, titles and first names.
CUES = {
    "iban": set("iban account konto kontonummer cuenta compte conto bank bic".split()),
    "local_phone": set("phone tel telephone call mobile fax cell telefon telefono teléfono téléphone handy móvil portable ring dial".split()),
    "name": set("name contact author signed from sincerely regards dear liebe lieber sehr estimado estimada cher chère nombre nom von by".split()),
    "secret": set("token key secret password passwd pwd apikey api_key access_key bearer credential credentials auth authorization passphrase passwort contraseña clave signature".split()),
    "ssn": set("ssn social security insurance taxpayer".split()),
}
OTHER = set("isbn order invoice version page item model commit build ticket no sha sha1 sha256 md5 hash checksum url http https rfc doi issn part figure table section".split())
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Madam Herr Frau Señor Señora Señorita Sr Sra Don Doña Monsieur Madame Mademoiselle Mme Mlle".split()
FIRST_NAMES = """Adam Alan Albert Alejandro Alexander Alice Amanda Amelia Amy Ana Andrea Andrew Angela Anna Anne Anthony Antonio Arthur Barbara Beatriz Benjamin
Brian Camille Carla Carlos Carmen Carol Caroline Catherine Charles Charlotte Christian Christine Christopher Claire Claudia Daniel David Diego Dominique Dorothy
Edward Elena Elizabeth Emily Emma Eric Fernando Florian François Frank Franz Gabriel George Grace Greta Hannah Hans Heinrich Helen Helga Henry Ines Isabel Jack
Jacques James Jane Jean Jennifer Jessica Johann John Jonas Jorge Joseph José Juan Julia Julien Jürgen Karen Karl Katharina Kevin Klaus Laura Lena Lisa Louis
Lucia Luis Lukas Manuel Margaret Maria Marie Mark Martin Mary Matthew Michael Miguel Monika Nancy Nicolas Oliver Pablo Patricia Paul Pedro Peter Philippe Pierre
Rafael Rebecca Richard Robert Rosa Ruth Sabine Samuel Sandra Sarah Sebastian Sofia Sophie Stefan Stephen Susan Teresa Thomas Ursula Victor William Wolfgang""".split()
_FIRST = frozenset(FIRST_NAMES)
#: Words within a name that aren't capitalised.
PARTICLES = frozenset("al bin da dal de degli dei del della den der di dos du el la las le los of ten ter van vom von y zu zum zur".split())

_DIGITS = re.compile(r"[0-9]")
_NUMBERED = re.compile(
    r"(?P<iban>\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b)"  # an IBAN has 34 characters at most
    r"|(?P<ssn>\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b)"
    r"|(?P<local_phone>(?:\([0-9]{2,4}\)[ ]?|\b[0-9]{3,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}\b)"
    r"|(?P<secret>(?<![A-Za-z0-9_+/@.-])[A-Za-z0-9_+/-]{16,}+(?![A-Za-z0-9_@]))"
)
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*+"
_NAMED = re.compile(rf"\b(?:(?P<title>{'|'.join(TITLES)})\b[.:]?[ ]+(?P<who>{_WORD})|(?P<first>(?:{'|'.join(FIRST_NAMES)})(?:-{_WORD})?)(?=[ ]))")
_NEXT = re.compile(rf"[ ]({_WORD})")
#: Words of two or more letters as parts of a path.
_PATH = re.compile(r"(?:^|[/.])[a-z_-]{2,}/")
LABELERS = 5
Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ outwards: to the left as far as the name's characters go, but not into the match before."""
    out, end, at = [], 0, text.find("@")
    while at != -1:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """The base kinds' spans by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_BEFORE = re.compile(r"([\w]+)[^\w]{0,6}$")
_RUN = re.compile(r"([0-9])\1{4}")


def _found(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Kind, start, end of every candidate, and whether a title stands before it; from left to right, none within another."""
    made = []
    if _DIGITS.search(text):
        for m in _NUMBERED.finditer(text):
            if m.lastgroup != "secret" or _DIGITS.search(m[0]):
                made.append((m.start(), m.end(), m.lastgroup, False))
    at = 0
    while m := _NAMED.search(text, at):
        start, at = (m.start("who"), m.end("who")) if m["title"] else (m.start("first"), m.end("first"))
        if not text[start].isupper():
            continue
        while word := _NEXT.match(text, at):
            end = word.end()
            while word and word[1] in PARTICLES:  # they belong to a name that goes on behind them
                word = _NEXT.match(text, end)
                end = word.end() if word else end
            if not word or not word[1][0].isupper():
                break
            at = end
        if m["title"] or " " in text[start:at]:
            made.append((start, at, "name", bool(m["title"])))
    last = 0
    for a, b, kind, titled in sorted(made):
        if a >= last:
            yield kind, a, b, titled
            last = b


_AROUND = re.compile(r"[^\W_]+")


def _side(c: str) -> int:
    """What sort of character stands beside a span: 0 none or white space, 1 a quote, = or :, 2 a letter or digit, 3 another."""
    return 0 if not c or c.isspace() else 1 if c in "=:\"'`" else 2 if c.isalnum() else 3


def candidates(text: str, taken: list[Span]) -> Iterator[tuple[Span, tuple[int, ...], tuple[int, ...]]]:
    """Candidate spans that meet no base span, their votes, and features of their own characters, neighbours and the words around.

    The labelers: the kind's form, gazetteers of words before it, what joins it to such a
    word, what encloses it, and how regular its characters are. No feature is a vote: words
    around are hashed, whatever list they are in.
    """
    ends = sorted((a, b) for _, a, b in taken)
    i = 0
    for kind, a, b, titled in _found(text):
        while i < len(ends) and ends[i][1] <= a:
            i += 1
        if i < len(ends) and ends[i][0] < b:
            continue
        s = text[a:b]
        near = text[max(0, a - 24) : a]
        word = (w := _BEFORE.search(near)) and w[1].lower() or ""
        digits, upper = sum(map(str.isdigit, s)), sum(map(str.isupper, s))
        after = text[b : b + 1]
        shape = {"iban": lambda: _iban_ok(s), "ssn": lambda: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00", "local_phone": lambda: 9 <= digits <= 12, "secret": lambda: len(s) >= 20 and digits >= 3 and (len(s) - digits) >= 3 and not _PATH.search(s), "name": lambda: " " in s}[kind]()
        gazetteer = 1 if titled or word in CUES[kind] or kind == "name" and s.split()[0].split("-")[0] in _FIRST else -1 if word in OTHER else 0
        context = 1 if near.rstrip()[-1:] in tuple("=:\"'`") else 0
        closed = 1 if near[-1:] in ('"', "'", "`") and after == near[-1:] else -1 if after.isalnum() else 0
        odd = (1 if _entropy(s) >= 3.2 else -1) if kind == "secret" else (1 if digits and not _RUN.search(s) else 0)
        around = [w.lower() for w in _AROUND.findall(near)[-2:][::-1]]
        around = [*around, *[""] * (2 - len(around)), (w[0].lower() if (w := _AROUND.search(text[b : b + 24])) else "")]
        votes = (1 if shape else 0 if kind == "name" else -1, gazetteer, context, closed, odd)
        features = (min(5, len(s) // 8), min(4, 5 * digits // max(1, len(s))), min(3, 4 * upper // max(1, len(s))), min(3, len(set(s)) // 6), _side(near[-1:]), _side(after), *[zlib.crc32(w.encode()) % (AROUND - 1) + 1 if w else 0 for w in around])
        yield (kind, a, b), votes, features


#: Shares of votes against, none and for that labelers start from, by whether a span is private. All candidates have their kind's form, so form tells little for a span and much against it; the word before it tells most.
_FORM = ((0.3, 0.25, 0.45), (0.05, 0.3, 0.65))
_WORD_BEFORE = ((0.25, 0.7, 0.05), (0.03, 0.25, 0.72))
_SIGNS = ((0.1, 0.75, 0.15), (0.05, 0.6, 0.35))
STARTS = (_FORM, _WORD_BEFORE, _SIGNS, _SIGNS, _FORM)
#: The start, with this share of private spans, counts as so many spans and as many again as there are, so that neither few votes nor labelers that go together turn one round.
START_PRIVATE, START_COUNT = 0.3, 20


def _em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior that each vote pattern marks private data: two classes, labelers independent given the class."""
    votes = patterns + 1
    start = np.array(STARTS).transpose(1, 0, 2)
    table, prior, held = start.copy(), START_PRIVATE, START_COUNT + counts.sum()
    for _ in range(rounds):
        log = [np.log(p) + sum(np.log(table[y, j, votes[:, j]]) for j in range(votes.shape[1])) for y, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        prior = float((post @ counts + START_PRIVATE * held) / (counts.sum() + held))
        for y, w in ((0, counts * (1 - post)), (1, counts * post)):
            for j in range(votes.shape[1]):
                seen = np.bincount(votes[:, j], w, 3) + held * start[y, j]
                table[y, j] = seen / seen.sum()
    return post


FEATURES = (6, 5, 4, 4, 4, 4)
#: Hash values of a word near a span, with one for none; the last word before it, the one before that, and the first after it.
AROUND, PLACES = 256, 3


def _one_hot(features: tuple[int, ...]) -> list[float]:
    out = [1.0]
    for v, n in zip(features[: len(FEATURES)], FEATURES, strict=True):
        out += [float(v == i) for i in range(n)]
    return out


class SpanModel:
    """For every kind, a classifier trained on the labelers' posteriors: logistic in a span's own features, with the log odds of the words around it.

    table: kind, votes, own features and how many spans; words: kind, votes, place, hash value
    of the word there and how many spans.
    """

    def __init__(self, table: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], words: list[tuple[str, tuple[int, ...], int, int, int]]):
        self.weights: dict[str, np.ndarray] = {}
        self.words: dict[str, np.ndarray] = {}
        for kind in ADDED:
            rows = [r for r in table if r[0] == kind]
            if not rows:
                continue
            by_votes: Counter = Counter()
            for _, v, _, n in rows:
                by_votes[v] += n
            patterns = list(by_votes)
            post = dict(zip(patterns, _em(np.array(patterns), np.array([by_votes[p] for p in patterns], float)), strict=True))
            x = np.array([_one_hot(f) for _, _, f, _ in rows])
            y, n = np.array([post[v] for _, v, _, _ in rows]), np.array([r[3] for r in rows], float)
            w, n = np.zeros(x.shape[1]), n / n.sum()
            for _ in range(60):  # Newton steps with a small ridge
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
                step = np.linalg.solve(h, x.T @ (n * (y - p)) - 1e-3 * w)
                w += step
                if np.abs(step).max() < 1e-6:
                    break
            self.weights[kind] = w
            near = np.zeros((2, PLACES, AROUND))
            for _, v, place, word, m in (r for r in words if r[0] == kind):
                near[:, place, word] += (m * (1 - post[v]), m * post[v])
            share = float(np.clip(y @ n, 0.01, 0.99))  # of private spans; a word seen nowhere tells nothing
            odds = np.log((near[1] + 2 * share) / (near[0] + 2 * (1 - share))) - math.log(share / (1 - share))
            self.words[kind] = np.clip(odds, -4, 4)

    def accepts(self, kind: str, features: tuple[int, ...]) -> bool:
        if kind not in self.weights:
            return False
        return float(np.dot(self.weights[kind], _one_hot(features)) + self.words[kind][range(PLACES), features[len(FEATURES) :]].sum()) > 0


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_CANDIDATES = "array<struct<kind:string,start:long,end:long,votes:array<int>,features:array<int>>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base_spans and candidates of every row: all that a text has to be read for."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    candidate = pa.struct([*span, ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, maybe = [], []
            for x in b.column(1):  # one text at a time
                t = x.as_py()
                own = base_spans(t) if t and ("@" in t or _DIGITS.search(t)) else []
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
                maybe.append([{"kind": k, "start": s, "end": e, "votes": v, "features": f} for (k, s, e), v, f in candidates(t or "", own)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(span)), pa.array(maybe, pa.list_(candidate))], names=["doc_id", "base_spans", "candidates"])

    rows = docs.select(id_of(docs, id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id long, base_spans {_SPANS}, candidates {_CANDIDATES}")


def fit(scanned: DataFrame) -> SpanModel:
    """Count votes with features, and votes with words near by, over all candidates of ``scan``'s rows and train on the counts.

    Both tables have a bounded number of rows: votes, features and hash values are few.
    """
    each = scanned.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", F.slice("c.features", 1, len(FEATURES)).alias("own"), F.slice("c.features", len(FEATURES) + 1, PLACES).alias("near"))
    table = each.groupBy("kind", "votes", "own").agg(F.count("*").alias("n")).collect()
    words = each.select("kind", "votes", F.posexplode("near").alias("place", "word")).groupBy("kind", "votes", "place", "word").agg(F.count("*").alias("n")).collect()
    return SpanModel(sorted((r["kind"], tuple(r["votes"]), tuple(r["own"]), r["n"]) for r in table), sorted((r["kind"], tuple(r["votes"]), r["place"], r["word"], r["n"]) for r in words))


def find_private(docs: DataFrame, model: SpanModel | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base_spans and added_spans (arrays of kind, start, end; code points, end exclusive) of every row.

    Without a model, one is fitted on docs itself; either way every text is read once. A null
    text counts as empty and has no spans; texts and spans of any length count whole. Repeated
    rows give repeated results; ids and other columns are not looked at, so their names don't
    matter, and an empty table gives no rows.
    """
    scanned = scan(docs, id_col=id_col, text_col=text_col)
    if model is None:
        scanned = stash(scanned, "private")
        model = fit(scanned)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen weights
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            added = []
            for maybe in b.column(2).to_pylist():
                some = [c for c in maybe if sent.value.accepts(c["kind"], c["features"])]
                added.append(sorted(({k: c[k] for k in ("kind", "start", "end")} for c in some), key=lambda c: (c["kind"], c["start"])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(added, span)], names=["doc_id", "base_spans", "added_spans"])

    return scanned.mapInArrow(decide, f"doc_id long, base_spans {_SPANS}, added_spans {_SPANS}")


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of spans that meet, the first stands."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join(out) + text[at:]


def digest_columns(found: DataFrame) -> DataFrame:
    """find_private's spans as counts, the base spans' SHA-256, all spans as text and their number."""
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(said(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), said(F.concat("base_spans", "added_spans")).alias("spans"), (F.size("base_spans") + F.size("added_spans")).cast("long").alias("n_spans"))


def sha256_of(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
