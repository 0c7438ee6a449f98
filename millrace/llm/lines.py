"""Line deduplication by an exact set-similarity join.

A line is the set of its words, each by its 64-bit hash. Lines with equal sets are one class.
For the others, words are ordered from rare to frequent (a table of a fixed size holds counts
by hash, so the order is the same everywhere). Two sets at the threshold must share a word
among the first few of each; lines meet by those prefix words, and a pair goes on only if its
lengths, the word's positions and a bitmap bound on the overlap allow the threshold. Short
lines made of frequent words meet by pairs of them, which are far rarer. Clusters
of such pairs are then verified on the full sets, and a line goes if an earlier one is equal
or similar.

The texts are read three times, and only entries, ids and the sets of candidates move: once
for every line's class and the words' counts, once for the prefix entries, and once for the
sets of classes that have a candidate, in the documents that hold one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clusters import _roots, components, verified
from .common import fresh, id_of, mix, named, pieces, quoted, ranges, stash, tidy, word_hashes, word_spans
from .grams import TOGETHER, bitmap, jaccard_verifier, marked

THRESHOLD = 0.8
#: Words are counted by this many bits of their hash, in this many slots.
COUNT_BITS, COUNT_SLOTS = 22, 64
#: Tasks whose counts are added up in one call.
COUNT_TASKS = 64
#: Words at least this frequent (as a power of two) are dealt out by line length too.
HOT_CODE = 2 * 13
#: Lines of up to about this many words meet under pairs of frequent words instead.
PAIR_WORDS = 40
#: Words of lines for each part in which entries meet, so that a part's size doesn't follow the input's.
PART_WORDS = 8_000_000
NEWLINE = 10

ENTRY = np.dtype([("word", "<u4"), ("n", "<u4"), ("room", "<u4"), ("id", "<i8"), ("bits", "<u8", (2,)), ("more", "<u8", (4,))])
#: Lines with more words than this carry the longer of two bitmaps too.
LONG_LINE = 128


def _offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line (without its newline) and the text it is in."""
    cuts = np.flatnonzero(data == NEWLINE)
    own = np.searchsorted(offsets, cuts, "right") - 1
    count = np.bincount(own, minlength=len(offsets) - 1) + 1
    text = np.repeat(np.arange(len(offsets) - 1), count)
    first = np.cumsum(count) - count
    starts, ends = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
    starts[first], ends[first + count - 1] = offsets[:-1], offsets[1:]
    inner = np.ones(len(text), bool)
    inner[first + count - 1] = False
    ends[inner] = cuts
    later = np.ones(len(text), bool)
    later[first] = False
    starts[later] = cuts + 1
    return starts, ends, text


def line_sets(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Text of every line, and its distinct words' hashes, from rare to frequent if codes are given: text, cut, hashes, code of each."""
    starts, ends, text = _offsets(data, offsets)
    words, word_ends, _ = word_spans(data, offsets)
    h = word_hashes(data, words, word_ends)
    # empty lines share their start with the next one's, which has the words
    line = np.repeat(np.arange(len(starts)), np.diff(np.searchsorted(words, np.append(starts, len(data) + 1))))
    code = np.zeros(len(h), np.uint8) if codes is None else codes[(h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
    key = (line.astype(np.uint64) << np.uint64(40)) | (code.astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    if len(starts) >= 1 << 24 or (same & (h[order][1:] != h[order][:-1])).any():  # the key doesn't tell them apart
        order = np.lexsort((h, code, line))
    h, line, code = h[order], line[order], code[order]
    new = np.ones(len(h), bool)
    new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
    h, line, code = h[new], line[new], code[new]
    return text, np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(starts)))]), h, code.astype(np.int64)


def class_ids(cut: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A 64-bit id of each line's set, whatever the order; 0 for the empty one."""
    a = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    n = (cut[1:] - cut[:-1]).astype(np.uint64)
    return np.where(n > 0, mix(a[cut[1:]] - a[cut[:-1]] + n), 0).view(np.int64)


_SURVEY = "doc long, key long, ids array<long>, task int, slot int, counts binary"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document with its lines' classes; then the task's counts of lines by their words' hash buckets."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()]
    names = ["doc", "key", "ids", "task", "slot", "counts"]
    total = np.zeros(2**COUNT_BITS, np.int64)
    for b in batches:
        for first, data, at in pieces(b.column(1), TOGETHER):
            text, cut, h, _ = line_sets(data, at)
            np.add.at(total, (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
            n = len(at) - 1
            ids = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), pa.array(class_ids(cut, h)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), b.column(2).slice(first, n), ids, *[pa.nulls(n, k) for k in kinds[3:]]], names=names)
    per = 2**COUNT_BITS // COUNT_SLOTS
    some = [s for s in range(COUNT_SLOTS) if total[s * per : (s + 1) * per].any()]
    counts = [zlib.compress(total[s * per : (s + 1) * per].astype("<i8").tobytes(), 1) for s in some]
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some), k) for k in kinds[:3]], pa.array([task] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(counts, pa.binary())], names=names)


def word_codes(survey: DataFrame) -> tuple[np.ndarray, int]:
    """Rarity of each hash bucket, twice the binary logarithm of its lines and one more; and the number of words of all lines.

    Tasks' counts are added up COUNT_TASKS at a time, in as many rounds as that takes.
    """
    per = 2**COUNT_BITS // COUNT_SLOTS

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), "<i8") for x in table["counts"])
        return pa.table({"slot": table["slot"].slice(0, 1).combine_chunks(), "task": table["task"].slice(0, 1).combine_chunks(), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    parts = survey.where("counts IS NOT NULL").select("slot", "task", "counts")
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        parts = parts.withColumn("task", (F.col("task") / COUNT_TASKS).cast("int")).groupBy("slot", "task").applyInArrow(tidy(add), "slot int, task int, counts binary")
        tasks = -(-tasks // COUNT_TASKS)
        if tasks == 1:
            break
    total = np.zeros(2**COUNT_BITS, np.int64)
    for r in parts.collect():
        total[r["slot"] * per : (r["slot"] + 1) * per] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return np.ceil(2 * np.log2(total + 1)).astype(np.uint8), int(total.sum())


def _prefix_entries(cut: np.ndarray, h: np.ndarray, code: np.ndarray, ids: np.ndarray, threshold: float, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """What each line says about itself under each of its prefix words, and the part each entry goes to."""
    n = np.diff(cut)
    _, once = np.unique(ids, return_index=True)  # a set that recurs in this batch says it once
    some = once[n[once] >= max(2, math.ceil(threshold / (1 - threshold) - 1e-9))]  # smaller sets match equal ones only
    bits = np.zeros((len(n), 6), np.uint64)
    if len(h):
        # parities don't fill up as lines get longer: each word in only one of two lines flips one bit
        full, spread, long = n > 0, mix(h), np.repeat(n > LONG_LINE, n)
        one = np.left_shift(np.uint64(1), spread & np.uint64(63))
        for k in range(2):
            bits[full, k] = np.bitwise_xor.reduceat(np.where((spread >> np.uint64(6)) & np.uint64(1) == k, one, np.uint64(0)), cut[:-1][full])
        if long.any():
            which, cuts = (spread[long] >> np.uint64(7)) & np.uint64(3), np.concatenate([[0], np.cumsum(n[n > LONG_LINE])[:-1]])
            for k in range(4):
                bits[n > LONG_LINE, 2 + k] = np.bitwise_xor.reduceat(np.where(which == k, one[long], np.uint64(0)), cuts)
    size = n[some]
    prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    band = np.floor(np.log(np.maximum(n, 1)) / math.log(1 / threshold) + 1e-9).astype(np.int64)
    last = int(math.log(PAIR_WORDS) / math.log(1 / threshold))

    def made(at: np.ndarray, row: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), ENTRY)
        out["word"], out["n"], out["id"], out["bits"], out["more"] = word & np.uint64(0xFFFFFFFF), n[row], ids[row], bits[row, :2], bits[row, 2:]
        out["room"] = cut[row] + n[row] - at  # words from this one on
        return out

    at = ranges(cut[some], prefix)
    row = np.repeat(some, prefix)
    hot = code[at] >= HOT_CODE
    rare = ~hot & (code[at] > 2)  # a word that occurs once brings no lines together
    out = [made(at[rare], row[rare], h[at[rare]])]
    keys = [mix(h[at[rare]] & np.uint64(0xFFFFFFFF))]
    # a frequent word of a long line is dealt out by the line's length too, under its own band and the next
    hot &= band[row] > last
    for above in (1, 2):
        out.append(made(at[hot], row[hot], h[at[hot]]))
        keys.append(mix((h[at[hot]] & np.uint64(0xFFFFFFFF)) + (band[row[hot]] + above).astype(np.uint64) * np.uint64(0x100000000)))
    # sets whose first common word is frequent have two such words in common among one more of their first words each; lines
    # alike differ by one band at most, so those of the band after the last are dealt out both ways
    size, prefix = n[some], np.minimum(prefix + 1, n[some])
    at, row = ranges(cut[some], prefix), np.repeat(some, prefix)
    hot = (code[at] >= HOT_CODE) & (band[row] <= last + 1)
    at, row = at[hot], row[hot]
    ends = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(row))
    here = np.arange(len(row))
    later = ends[np.searchsorted(ends, here, "right")] - here - 1 if len(row) else here
    one, two = np.repeat(here, later), ranges(here + 1, later)
    pair = mix(mix(h[at[one]]) + h[at[two]])
    out.append(made(at[one], row[one], pair))
    keys.append(mix(pair & np.uint64(0xFFFFFFFF)))
    return np.concatenate(out), (np.concatenate(keys) % np.uint64(parts)).astype(np.int64)


def _packed(entries: np.ndarray) -> bytes:
    """Columns one after another, lengths in two bytes each where that is enough."""
    wide = bool(len(entries)) and int(entries["n"].max()) >= 1 << 16
    small = [entries[c].astype("<u4" if wide else "<u2").tobytes() for c in ("n", "room")]
    return b"".join([np.array([len(entries), wide], "<u4").tobytes(), entries["word"].tobytes(), *small, entries["id"].tobytes(), entries["bits"].tobytes(), entries["more"][entries["n"] > LONG_LINE].tobytes()])


def _unpacked(blob: bytes) -> np.ndarray:
    n, wide = np.frombuffer(blob, "<u4", 2).tolist()
    out, at = np.empty(n, ENTRY), 8
    for column, kind, times in (("word", "<u4", 1), ("n", "<u4" if wide else "<u2", 1), ("room", "<u4" if wide else "<u2", 1), ("id", "<i8", 1), ("bits", "<u8", 2)):
        plain = np.frombuffer(blob, kind, n * times, at)
        out[column], at = plain.reshape(n, times) if times > 1 else plain, at + plain.nbytes
    out["more"] = 0
    out["more"][out["n"] > LONG_LINE] = np.frombuffer(blob[at:], "<u8").reshape(-1, 4)
    return out


def _meeting(entries: np.ndarray) -> np.ndarray:
    """The entries whose word another line has too, by word, then length; a line that recurs says it once."""
    word, ids, n = (np.ascontiguousarray(entries[c]) for c in ("word", "id", "n"))
    high = word.astype(np.uint64) << np.uint64(32)
    order = np.argsort(high | (mix(ids.view(np.uint64)) >> np.uint64(32)))
    w, i = word[order], ids[order]
    first = np.ones(len(order), bool)
    first[1:] = (w[1:] != w[:-1]) | (i[1:] != i[:-1])
    order, w = order[first], w[first]
    same, met = w[1:] == w[:-1], np.zeros(len(w), bool)
    met[1:] = same
    met[:-1] |= same
    order = order[met]
    return entries[order[np.argsort(high[order] | n[order])]]


def candidate_edges(entries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all lines which may match under some word: (id, smallest id it is joined to here).

    Lines that are joined already aren't compared again, and what is found is reduced to a
    root per line as it grows, so a word's many alike lines leave no list of pairs.
    """
    entries = _meeting(entries)
    word, n, room, bits, more = entries["word"].copy(), entries["n"].astype(np.int64), entries["room"].astype(np.int64), entries["bits"], entries["more"]
    ids, node = np.unique(entries["id"], return_inverse=True)
    root, x, y, held = np.arange(len(ids)), [], [], 0
    i, d = np.arange(max(0, len(entries) - 1)), 1
    while len(i):
        j = i + d
        ok = (word[i] == word[j]) & (n[i] >= threshold * n[j] - 1e-9)  # length filter; later ones are longer still
        i = i[ok]
        a = i[root[node[i]] != root[node[i + d]]]
        b = a + d
        need = np.ceil(threshold / (1 + threshold) * (n[a] + n[b]) - 1e-9)
        fits = np.minimum(room[a], room[b]) >= need - np.minimum(n[a] - room[a], n[b] - room[b])  # positional filter
        a, b, need = a[fits], b[fits], need[fits]
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        both = np.flatnonzero((n[a] > LONG_LINE) & (n[b] > LONG_LINE))
        differ[both] = np.maximum(differ[both], np.bitwise_count(more[a[both]] ^ more[b[both]]).sum(axis=1, dtype=np.int64))
        close = (n[a] + n[b] - differ) // 2 >= need  # bits differ by at most the words in only one line
        x.append(node[a[close]])
        y.append(node[b[close]])
        held += len(x[-1])
        if held > len(ids):
            x, y = [np.arange(len(ids)), *x], [root, *y]
            root, x, y, held = _roots(len(ids), np.concatenate(x), np.concatenate(y)), [], [], 0
        d += 1
        i = i[i + d < len(entries)]
    root = _roots(len(ids), np.concatenate([np.arange(len(ids)), *x]), np.concatenate([root, *y]))
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root][moved]


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc, key, gone and again: the numbers (from 0) of the lines that go, for each document that has any.

    doc is the id (the smallest long for null), key is xxhash64(id, text). A line goes if its
    set of words is equal to an earlier line's or has at least the threshold's Jaccard
    similarity to it, whether or not the earlier one stays; earlier by id (null first), then
    key among documents of one id, then line. Lines without words stay. For rows with the same
    id and text, gone tells what the first of them loses, and again, which is null for others,
    what each further one does: every line that has words.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(id_of(docs, id_col), F.lit(-(2**63))).alias("doc"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(quoted(id_col), quoted(text_col)).alias("key"))
    survey = stash(texts.mapInArrow(tidy(_survey), _SURVEY), "line-survey")
    table, words = word_codes(survey)
    codes, per_doc = spark.sparkContext.broadcast(table), survey.where("counts IS NULL").select("doc", "key", "ids")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), words // PART_WORDS)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, at in pieces(b.column(1), TOGETHER):
                _, cut, h, code = line_sets(data, at, codes.value)
                entries, part = _prefix_entries(cut, h, code, class_ids(cut, h), threshold, parts)
                order = np.argsort(part, kind="stable")
                entries, part = entries[order], part[order]
                new = np.flatnonzero(np.diff(part, prepend=-1))
                blobs = [_packed(entries[x:y]) for x, y in zip(new, np.append(new[1:], len(part)), strict=True)] if len(part) else []
                yield pa.RecordBatch.from_arrays([pa.array(part[new].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "entries"])

    def meet(table: pa.Table) -> pa.Table:
        a, b = candidate_edges(np.concatenate([_unpacked(x) for x in table["entries"].to_pylist()]), threshold)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    edges = texts.mapInArrow(tidy(enter), "part int, entries binary").groupBy("part").applyInArrow(tidy(meet), "a long, b long")
    clusters = stash(components(edges, "line-candidates").select(F.col("node").alias("id"), F.col("root").alias("cluster")), "line-clusters")
    lines = per_doc.select("doc", "key", F.posexplode("ids").alias("line", "id")).where("id <> 0")
    classes = stash(lines.groupBy("id").agg(F.min(F.struct("doc", "key", "line")).alias("first"), F.count("*").alias("n")).select("id", "n", "first.*"), "line-classes")
    bits = spark.sparkContext.broadcast(bitmap(clusters.select("id")))

    def concerned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1)
            own = np.repeat(np.arange(len(b)), np.diff(ids.offsets.to_numpy()))
            some = np.unique(own[marked(bits.value, ids.flatten().to_numpy())])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some))], names=["key"])

    holders = spark.sparkContext.broadcast(bitmap(per_doc.select("key", "ids").mapInArrow(concerned, "key long")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.column(1).filter(pa.array(marked(holders.value, b.column(2).to_numpy())))
            for _, data, at in pieces(some, TOGETHER):
                _, cut, h, _ = line_sets(data, at)
                ids = class_ids(cut, h)
                _, once = np.unique(ids, return_index=True)
                once = once[(np.diff(cut)[once] > 0) & marked(bits.value, ids[once])]
                yield pa.RecordBatch.from_arrays([pa.array(ids[once]), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in once], pa.binary())], names=["id", "set"])

    sets = texts.mapInArrow(tidy(gather), "id long, set binary").groupBy("id").agg(F.first("set").alias("set"))
    sets = stash(sets.withColumn("bytes", F.octet_length("set")), "line-sets")
    order = classes.select("id", F.array(F.col("doc"), F.col("key"), F.col("line").cast("long")).alias("at"))
    found = verified(clusters.join(order, "id").withColumn("n", F.lit(1).cast("long")), sets, jaccard_verifier(threshold), "line")
    similar = stash(found.where("earlier").select("id").distinct(), "lines-similar")
    # every line of a class that is large or like an earlier one goes, but for the first line of a class that is like none
    hit = spark.sparkContext.broadcast(bitmap(classes.where("n > 1").select("id").unionByName(similar)))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            cut, found_here = ids.offsets.to_numpy(), marked(hit.value, ids.flatten().to_numpy()) & (ids.flatten().to_numpy() != 0)
            at = np.flatnonzero(found_here)
            own = np.searchsorted(cut - cut[0], at, "right") - 1
            some, first = np.unique(own, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array((at - (cut[own] - cut[0])).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(some)) for k in (0, 1)], lists], names=["doc", "key", "gone"])

    def in_hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(marked(hit.value, b.column(0).to_numpy())))

    # the bitmap also hits classes by chance: their only lines are firsts too, and stay
    firsts = classes.select("id", "doc", "key", "line").mapInArrow(in_hit, "id long, doc long, key long, line int").join(similar, "id", "left_anti")
    stay = firsts.groupBy("doc", "key").agg(F.collect_list("line").alias("stay"))
    copies = per_doc.groupBy("doc", "key").agg(F.count("*").alias("n"), F.first("ids").alias("ids")).where("n > 1")
    worded = F.filter(F.transform("ids", lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    lost = per_doc.mapInArrow(touched, "doc long, key long, gone array<int>").groupBy("doc", "key").agg(F.first("gone").alias("gone"))
    out = lost.join(stay, ["doc", "key"], "left").join(copies.select("doc", "key", worded.alias("again")), ["doc", "key"], "left")
    gone = F.when(F.col("stay").isNull(), F.col("gone")).otherwise(F.array_except("gone", "stay"))
    return out.select("doc", "key", gone.alias("gone"), "again").where(F.col("again").isNotNull() | (F.size("gone") > 0))


@F.arrow_udf(T.StringType())
def _cut(text: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for t, lost in zip(text.to_pylist(), gone.to_pylist(), strict=True):
        if t is not None and lost:
            lost = set(lost)
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in lost)
        out.append(t)
    return pa.array(out, pa.string())


def without_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """docs with the repeated lines cut out of their texts; other columns stay as they are, and so do rows, but with drop_emptied those whose every line with words goes.

    With counts, the columns n_lines and n_removed follow, in place of any of those names. A
    null text stays null and has no lines; a text all of whose lines go becomes empty. Lines
    are cut at newlines (0x0A) alone, however long they or the texts are. Of rows with the
    same id and text one is the first, and the others lose every line that has words; rows
    without an id are told apart by their texts. Ids must be whole numbers. An empty table
    gives no rows.
    """
    spark, text_col = docs.sparkSession, named(docs, text_col)
    gone = stash(repeated_lines(docs, id_col=id_col, text_col=text_col, threshold=threshold), "lines-gone")
    bits = spark.sparkContext.broadcast(bitmap(gone.select("key")))
    doc, key, lost, again, mark, place = (fresh(docs, c) for c in ("_doc", "_key", "_gone", "_again", "_touched", "_place"))

    @F.arrow_udf(T.BooleanType())
    def touched(key: pa.Array) -> pa.Array:
        return pa.array(marked(bits.value, key.to_numpy()))

    # most documents lose nothing, and a bitmap of a fixed size says so without moving them
    keyed = docs.withColumns({doc: F.coalesce(id_of(docs, id_col), F.lit(-(2**63))), key: F.xxhash64(quoted(id_col), quoted(text_col))}).withColumn(mark, touched(key))
    whole = keyed.where(~F.col(mark)).withColumn(lost, F.lit(None).cast("array<int>"))
    found = keyed.where(mark).join(gone.toDF(doc, key, lost, again), [doc, key], "left")
    if gone.where("again IS NOT NULL").isEmpty():
        found = found.drop(again)
    else:  # which row is the first is written down, so that it stays so if a task runs again
        found = stash(found.withColumn(place, F.monotonically_increasing_id()), "lines-again")
        first = fresh(found, "_first")
        firsts = found.where(F.col(again).isNotNull()).groupBy(doc, key).agg(F.min(place).alias(first))
        found = found.join(stash(firsts, "lines-firsts"), [doc, key], "left")
        found = found.withColumn(lost, F.when(F.col(place) > F.col(first), F.col(again)).otherwise(F.col(lost))).drop(again, place, first)
    found = found.withColumn(place, _cut(quoted(text_col).cast("string"), F.col(lost)))
    if drop_emptied:
        found = found.where((F.coalesce(F.size(lost), F.lit(0)) < 1) | F.col(place).rlike(r"[^\x20\x09-\x0D]"))
    kept = found.unionByName(whole.withColumn(place, quoted(text_col)))
    columns = [F.col(place).cast(docs.schema[c].dataType).alias(c) if c == text_col else quoted(c) for c in docs.columns if not (counts and c.lower() in ("n_lines", "n_removed"))]
    if counts:
        ends = F.octet_length(quoted(text_col)) - F.octet_length(F.replace(quoted(text_col), F.lit("\n"), F.lit("")))
        columns += [F.coalesce(ends + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.when(quoted(text_col).isNotNull(), F.size(lost)), F.lit(0)).cast("long").alias("n_removed")]
    return kept.select(*columns)
