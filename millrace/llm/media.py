"""Media columns: sequences of text and media whose payloads are stored once and joined by digest.

``store`` writes payloads as lossless 8-bit greyscale PNGs to a table keyed by the SHA-256 of
the payload. ``sequences`` parses HTML into ordered text and media items. ``described`` reads
the stored bytes back, decodes them and computes features; ``resolve`` joins items to what
is wanted of their media by digest. Features are computed before the join, so payload bytes
are never shuffled, and the join's two sides are a row per reference and per medium.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, id_of, quoted, stash_path, tidy
from .html import ITEM, interleaved

WIDTH = 576
_PNG = b"\x89PNG\r\n\x1a\n"


def padded(payload: bytes, multiple: int = WIDTH) -> bytes:
    """payload with bytes 255 up to a positive multiple."""
    return payload + b"\xff" * (max(1, -(-len(payload) // multiple)) * multiple - len(payload))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """A greyscale PNG whose samples, row by row, are the payload; its length must be a positive multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    filtered = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(filtered, 3)) + _chunk(b"IEND", b"")


def decode(png: bytes) -> bytes:
    """The samples of a PNG as ``encode`` writes them; raises ValueError for anything else or if a checksum fails."""
    if png[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, size = 8, [], (0, 0)
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean and deviation in thousandths, shares of eight ranges of samples in thousandths, and a 64-bit average hash of the image's 8 x 8 means."""
    x = np.frombuffer(payload, np.uint8)
    n, total = len(x), int(x.sum(dtype=np.int64))
    square = int((x.astype(np.int64) ** 2).sum())
    spread = int(max(0, n * square - total * total) ** 0.5 * 1000) // n
    shares = [int(v) * 1000 // n for v in np.bincount(x >> 5, minlength=8)]
    cuts = np.arange(8) * len(x) // 8
    means = np.add.reduceat(x.astype(np.int64), (np.arange(64) * n) // 64) if n >= 64 else np.zeros(64, np.int64)
    bits = "".join("1" if m * 64 >= total else "0" for m in means.tolist())
    return f"mean={total * 1000 // n};spread={spread};shares={','.join(map(str, shares))};hash={int(bits, 2):016x};eighths={','.join(str(int(v)) for v in x[cuts])}"


def store(payloads: DataFrame, path: str) -> DataFrame:
    """Write the payloads (one binary column) to path as PNGs: digest, media. Returns the stored table.

    Each task stores a payload that recurs in it once; copies from different tasks have
    equal bytes, and readers take any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                made = {}
                for text in b.column(0).slice(at, 256).to_pylist():
                    payload = padded(text or b"")
                    if (key := hashlib.sha256(payload).hexdigest()) not in made:
                        made[key] = encode(payload)
                yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array(list(made.values()), pa.binary())], names=["digest", "media"])

    column = payloads.columns[0]
    made = payloads.select(F.col(f"`{column}`").cast("binary").alias("payload")).mapInArrow(tidy(run), "digest string, media binary")
    made.write.option("compression", "none").parquet(path)  # PNGs don't get smaller
    return payloads.sparkSession.read.schema(made.schema).parquet(path)


def described(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, a row per digest: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for digest, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                payload = decode(media)
                for column, v in zip(out, (digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)), strict=True):
                    column.append(v)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    found = stored.select("digest", "media").mapInArrow(tidy(run), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.dropDuplicates(["digest"])


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", *, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, items (position, kind, text, ref, caption in document order) and the columns of keep of every row; null HTML has no items."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("items", T.ArrayType(ITEM)), *[pages.schema[c] for c in keep]])
    kind = pa.list_(pa.struct([("position", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                items = [interleaved(x or "") for x in b.column(1).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), pa.array(items, kind), *[c.slice(at, 256) for c in b.columns[2:]]], names=schema.names)

    return pages.select(id_of(pages, id_col).alias("doc_id"), quoted(html_col).cast("string").alias("html"), *[quoted(c) for c in keep]).mapInArrow(tidy(run), schema)


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """items (with ref) joined to media's columns where ref is ``sha256:`` and its digest; unresolved ones keep nulls."""
    key = fresh(items, "_ref")
    facts = media.withColumn(key, F.concat(F.lit("sha256:"), "digest")).drop("digest")
    return items.join(facts, items["ref"] == F.col(key), "left").drop(key)


def documents_of(items: DataFrame) -> DataFrame:
    """doc_id and items again, a row per document, from resolved items (doc_id, position and more) in order of position.

    A document's items are as many as its page says; equal ids are one document.
    """
    columns = [c for c in items.columns if c not in ("doc_id", "position")]
    return items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", *columns))).alias("items"))


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's text as a stored medium, found again through an interleaved page that shows the text beside it.

    The page's paragraphs are the text's lines, and the figure stands among them, after the
    first one. Returns doc_id, n_bytes, position (of the medium), caption, n_items (text items
    and the medium) and ``described``'s columns. A null text counts as empty, whose payload is
    one row of 255; equal texts share a medium; repeated rows and null ids give a row each;
    texts of any length count whole, one at a time; an empty table gives no rows. Other
    columns are not read.
    """
    rows = docs.select(id_of(docs, id_col).alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    stored = store(rows.select("text"), stash_path(docs.sparkSession, "media"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                some, pages = b.slice(at, 256), []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    digest = hashlib.sha256(padded(text.encode())).hexdigest()
                    first, _, rest = text.partition("\n")
                    body = "".join(f"<p>{html.escape(x)}</p>" for x in rest.split("\n"))
                    pages.append(f'<article><p>{html.escape(first)}</p><figure><img src="sha256:{digest}"><figcaption>document {doc}</figcaption></figure>{body}</article>')
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(pages, pa.string())], names=["doc_id", "n_bytes", "html"])

    pages = rows.select("doc_id", "text", "n_bytes").mapInArrow(tidy(compose), "doc_id long, n_bytes long, html string")
    items = sequences(pages, "doc_id", keep=("n_bytes",)).withColumn("n_items", F.size("items").cast("long"))
    items = items.select("doc_id", "n_bytes", "n_items", F.explode("items").alias("i")).where("i.ref IS NOT NULL")
    return resolve(items.select("doc_id", "n_bytes", "n_items", "i.position", "i.ref", "i.caption"), described(stored)).drop("ref")
