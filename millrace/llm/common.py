"""What the training-data operators share: stored intermediate tables, and words as numpy arrays.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D), which for UTF-8
is the same as a run of such characters. Texts are handled as the flat buffers Arrow holds
them in, so a batch costs a few numpy passes instead of a Python object per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import fresh, quoted, stash, stash_path  # noqa: F401  for the operators

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
KEEP = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 8)] + [2**64 - 1], dtype=np.uint64)
#: Words longer than this many bytes are hashed one by one instead of in step with the others.
LONG_WORD = 256
#: Bytes of texts looked at together where words are only counted.
WINDOW = 1 << 20


def give_back() -> None:
    """Give memory that isn't in use any more back to the system: Python workers live on, idle or with another query's tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc needn't be asked
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """run, for mapInArrow, applyInArrow or an Arrow function, with memory given back after each batch or group and at the end."""
    if inspect.isgeneratorfunction(run):

        def each(batches):
            for b in batches:
                yield b
                give_back()

        def whole(batches):
            try:
                yield from run(each(batches))
            finally:
                give_back()

        return whole

    # Spark counts a function's arguments
    def one(table):
        try:
            return run(table)
        finally:
            give_back()

    def two(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return two if len(inspect.signature(run).parameters) == 2 else one


#: Rows of two or three numbers that are sent to every task at most, about 20 MB; what has more is joined by shuffles.
BROADCAST_ROWS = 500_000


def looked_up(df: DataFrame, table: DataFrame, on: str | Column | list[str], how: str, name: str) -> DataFrame:
    """df joined with a table that has one narrow row per key, whatever the share of df's rows that one key has.

    The table is stored and counted. Up to BROADCAST_ROWS rows go to every task, so df stays in
    place; a larger one is joined by shuffles of both sides, which Spark splits where a key is frequent.
    """
    table = stash(table, name)
    return df.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, on, how)


def few_rows(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A table of a few rows of the driver's. As Arrow, they need no Python worker; a list would start workers of its own on every executor, which stay."""
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema))


def named(df: DataFrame, name: str) -> str:
    """The name under which df has that column: as Spark does, in any case of its letters unless the session tells cases apart."""
    exact = str(df.sparkSession.conf.get("spark.sql.caseSensitive")).lower() == "true"
    return next((c for c in df.columns if c == name or (not exact and c.lower() == name.lower())), name)


def id_of(df: DataFrame, name: str) -> Column:
    """The id column as long; TypeError if it doesn't hold whole numbers, as text that is none would fail in a task."""
    kind = df.select(quoted(name)).schema[0].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"ids must be whole numbers; {name} is {kind.simpleString()}")
    return quoted(name).cast("long")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, where, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, together: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about a bounded total: index of the first, bytes, offsets."""
    data, at = flat(column)
    first = 0
    while first < len(at) - 1:
        last = min(max(first + 1, int(np.searchsorted(at, at[first] + together, "right")) - 1), len(at) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that aren't space, and for each text the index of its first one (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~space[data]
    turns = np.flatnonzero(word[1:] != word[:-1]) + 1
    between = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    between = between[word[between - 1] & word[between]]  # a word ends where its text does
    if len(between):
        turns = np.insert(turns, np.repeat(np.searchsorted(turns, between), 2), np.repeat(between, 2))
    turns = np.concatenate([[0][: int(word[0])], turns, [len(data)][: int(word[-1])]]).astype(np.int64)
    starts, ends = turns[0::2], turns[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P1
    return h ^ (h >> np.uint64(32))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of data on, as one number; the last seven places are left out."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, eight bytes at a time; the same on every machine."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    eight = eights(np.concatenate([data, np.zeros(8, np.uint8)]))
    size = ends - starts
    h = size.astype(np.uint64) * _P1
    todo, step = np.arange(len(starts)), 0
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        todo = np.flatnonzero(size <= LONG_WORD)
    while len(todo):
        whole = len(todo) == len(h)
        left = (size if whole else size[todo]) - step
        block = eight[(starts if whole else starts[todo]) + step] & KEEP[np.minimum(left, 8)]
        if whole:
            h = mix(h ^ block)
        else:
            h[todo] = mix(h[todo] ^ block)
        step += 8
        todo = todo[left > 8]
    for i in long:
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words_in(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of words of each text, a window of bytes at a time: what is held besides the texts doesn't grow with them."""
    counts = np.zeros(len(offsets) - 1, np.int64)
    for at in range(0, len(data), WINDOW):
        end = min(at + WINDOW, len(data))
        word = ~IS_SPACE[data[max(at - 1, 0) : end]]
        word, before = (word[1:], word[:-1]) if at else (word, np.append(False, word[:-1]))
        first, last = int(np.searchsorted(offsets, at, "right")) - 1, int(np.searchsorted(offsets, end, "left"))
        begins, edges = word & ~before, offsets[first : last + 1]
        inside = edges[(edges >= at) & (edges < end)] - at
        begins[inside] = word[inside]  # a word ends where its text does
        counts[first:last] += np.diff(np.searchsorted(np.flatnonzero(begins) + at, edges))
    return counts


@F.arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Number of words of each text; 0 for null."""
    counts = pa.array(words_in(*flat(text)), pa.int64())
    give_back()
    return counts


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of start, start + 1, ... (count values) for every pair."""
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)
