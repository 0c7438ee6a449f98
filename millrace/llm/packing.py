"""Packing documents into training sequences by minimum bin slack.

A document's ids are cut into full windows; what remains of each document is an item shorter
than a window. Items meet in a pool. Each window takes the longest item and then the multiset
of other lengths that comes closest to the room left: a subset-sum over a Python integer used
as a bitset, one shift per (length, power-of-two count), whose intermediate bitsets are
walked back to get the counts.

One map over the input partitions does all of it: no text or id is ever shuffled, a partition
holds at most ``pool_tokens`` ids beside the batch in hand, and a lost task repeats alone.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import KEEP, eights, id_of, pieces, quoted, ranges, tidy, word_hashes, word_spans

CAPACITY = 4096
#: Ids held back per task for the subset-sum to choose from.
POOL_TOKENS = 2_000_000
#: Words and stems kept per task with their ids, about 50 MB; when there are more, all are forgotten.
CACHE_WORDS = 700_000
CACHED_WORD_BYTES = 48
#: Bytes of texts tokenized at a time, more only where one text has more.
TOGETHER = 2_000_000

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def fill(lengths: list[int], counts, room: int) -> dict[int, int]:
    """Counts by length of the multiset whose sum is the largest that is at most room.

    lengths: the distinct lengths on offer; counts[length]: how many there are of each.
    Sums are bits of an integer. Stops as soon as the room can be filled exactly.
    """
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for n in lengths:
        left, k = min(int(counts[n]), room // n), 1
        while left > 0:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & full
            left, k = left - k, 2 * k
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, defaultdict(int)
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            taken[n] += k
            at -= n * k
    return dict(taken)


class Packer:
    """Collects documents' ids and gives back pieces with their places."""

    def __init__(self, capacity: int, pool_tokens: int, first_sequence: int, with_ids: bool):
        self.capacity, self.pool_tokens, self.with_ids = capacity, pool_tokens, with_ids
        self.items: dict[int, list] = defaultdict(list)
        self.counts = np.zeros(capacity + 1, np.int64)
        self.pooled, self.next, self.out = 0, first_sequence, [[] for _ in PIECES]

    def _hold(self, item: tuple) -> None:
        n = len(item[3]) // 4
        self.items[n].append(item)
        self.counts[n] += 1
        self.pooled += n

    def _take(self, n: int) -> tuple:
        self.counts[n] -= 1
        self.pooled -= n
        return self.items[n].pop()

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, total, start, ids in pieces:
            n = len(ids) // 4
            for column, value in zip(self.out, (doc, start, n, zlib.crc32(ids), total, self.next, offset, ids if self.with_ids else None), strict=True):
                column.append(value)
            offset += n
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        total, wide = len(ids) // 4, 4 * self.capacity
        whole = len(ids) // wide * wide
        for at in range(0, whole, wide):
            self._emit([(doc, total, at // 4, ids[at : at + wide])])
        if whole < len(ids):
            self._hold((doc, total, whole // 4, ids[whole:]))
        if self.pooled > self.pool_tokens:
            while self.pooled > self.pool_tokens // 2:
                self._window()

    def _window(self) -> None:
        """One full window from a pool that holds at least as much as a window."""
        longest = int(np.flatnonzero(self.counts)[-1])
        pieces = [self._take(longest)]
        room = self.capacity - longest
        if room:
            on_offer = np.flatnonzero(self.counts[: room + 1])[::-1].tolist()
            for n, k in fill(on_offer, self.counts, room).items():
                pieces += [self._take(n) for _ in range(k)]
                room -= n * k
        while room and self.pooled:  # no multiset fits exactly: a longer item is cut
            doc, total, start, ids = self._take(int(np.flatnonzero(self.counts)[-1]))
            pieces.append((doc, total, start, ids[: 4 * room]))
            if len(ids) > 4 * room:
                self._hold((doc, total, start + room, ids[4 * room :]))
            room -= min(room, len(ids) // 4)
        self._emit(pieces)

    def finish(self) -> None:
        """The rest goes to full windows and then to sequences whose lengths are powers of two, so nothing is padded."""
        while self.pooled >= self.capacity:
            self._window()
        rest = [item for n in sorted(self.items, reverse=True) for item in self.items[n]]
        for bit in reversed(range(self.pooled.bit_length())):
            room, pieces = (1 << bit) if self.pooled >> bit & 1 else 0, []
            while room:
                doc, total, start, ids = rest.pop()
                pieces.append((doc, total, start, ids[: 4 * room]))
                if len(ids) > 4 * room:
                    rest.append((doc, total, start + room, ids[4 * room :]))
                room -= len(pieces[-1][3]) // 4
            if pieces:
                self._emit(pieces)
        self.items.clear()
        self.pooled = 0

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(self.out, PIECES.types, strict=True)], schema=PIECES)
        self.out = [[] for _ in PIECES]
        return made


#: Last bytes of the letters U+00C0-U+00FF, all but the multiplication and division signs.
_LATIN = frozenset(range(0x80, 0xC0)) - {0x97, 0xB7}


def _stem(word: bytes) -> tuple[bytes, int]:
    """A word's stem and the mark after it, 0 if there is none or it can't be told apart safely."""
    if b"<|" in word:  # in lower case it could become a special token
        return word, 0
    if len(word) > 2 and word[-1] in b",.":
        before = word[-2]
        if before < 0x80 and chr(before).isalpha() or before in _LATIN and word[-3] == 0xC3:
            return word[:-1].lower(), word[-1]
    return word.lower(), 0


class WordTable:
    """Words by their bytes with the ids of each, in flat arrays: no Python object per word.

    A word is found by its hash, by open addressing, and counts as found only if its bytes are the same.
    """

    SLOTS = 21

    def __init__(self):
        self.slots = np.full(1 << self.SLOTS, -1, np.int32)
        self.n = 0
        self.hash, self.head = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.at, self.size, self.first, self.count = (np.zeros(1024, np.int32) for _ in range(4))
        self.bytes, self.used_bytes = np.zeros(1 << 16, np.uint8), 0
        self.ids, self.used_ids = np.zeros(1 << 16, np.uint32), 0

    def clear(self) -> None:
        self.slots.fill(-1)
        self.n = self.used_bytes = self.used_ids = 0

    @property
    def full(self) -> bool:
        return self.n >= CACHE_WORDS

    def find(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each word data[start : start + size] with hash h, or -1. data has eight bytes more at its end."""
        out = np.full(len(h), -1, np.int64)
        slot, todo, mask = self._slot(h), np.arange(len(h)), (1 << self.SLOTS) - 1
        while len(todo):
            entry = self.slots[slot]
            there = entry >= 0
            same = there & (self.hash[entry] == h[todo])
            out[todo[same]] = entry[same]
            on = there & ~same
            todo, slot = todo[on], (slot[on] + 1) & mask
        found = np.flatnonzero(out >= 0)
        entry, start, size = out[found], starts[found], size[found]
        right = (self.size[entry] == size) & (eights(data)[start] & KEEP[np.minimum(size, 8)] == self.head[entry])
        own, step = eights(self.bytes), 8
        more = np.flatnonzero(right & (size > step))
        while len(more):
            keep = KEEP[np.minimum(size[more] - step, 8)]
            right[more] = eights(data)[start[more] + step] & keep == own[self.at[entry[more]] + step] & keep
            step += 8
            more = more[right[more] & (size[more] > step)]
        out[found[~right]] = -1
        return out

    def put(self, words: list[bytes], h: np.ndarray, ids: list[bytes]) -> None:
        """Enter words that aren't there, as far as the slots reach; ids are little-endian unsigned 32-bit."""
        fits = [i for i, w in enumerate(words) if len(w) <= CACHED_WORD_BYTES][: (1 << self.SLOTS) // 2 - self.n]
        if not fits:
            return
        n, m = self.n, self.n + len(fits)
        size = np.array([len(words[i]) for i in fits])
        count = np.array([len(ids[i]) // 4 for i in fits])
        raw, wide = b"".join([words[i] for i in fits]), b"".join([ids[i] for i in fits])
        self.hash, self.head, self.at, self.size, self.first, self.count = (_room(a, m) for a in (self.hash, self.head, self.at, self.size, self.first, self.count))
        self.bytes, self.ids = _room(self.bytes, self.used_bytes + len(raw) + 8), _room(self.ids, self.used_ids + len(wide) // 4)
        self.bytes[self.used_bytes : self.used_bytes + len(raw)] = np.frombuffer(raw, np.uint8)
        self.ids[self.used_ids : self.used_ids + len(wide) // 4] = np.frombuffer(wide, "<u4")
        self.hash[n:m], self.size[n:m], self.count[n:m] = h[fits], size, count
        self.at[n:m], self.first[n:m] = self.used_bytes + np.cumsum(size) - size, self.used_ids + np.cumsum(count) - count
        self.head[n:m] = eights(self.bytes)[self.at[n:m]] & KEEP[np.minimum(size, 8)]
        self.used_bytes, self.used_ids, self.n = self.used_bytes + len(raw), self.used_ids + len(wide) // 4, m
        todo, slot = np.arange(n, m), self._slot(self.hash[n:m])
        while len(todo):
            free = np.flatnonzero(self.slots[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.slots[slot[won]] = todo[won]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.SLOTS) - 1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def ids_of(self, entry: int) -> bytes:
        return self.ids[self.first[entry] : self.first[entry] + self.count[entry]].tobytes()


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, len(a) * 3 // 2), a.dtype)
    out[: len(a)] = a
    return out


class WordIds:
    """Ids of whole texts, word by word: neither the tokenizer's normalizer nor its splitter joins or looks across ASCII white space.

    A word that isn't known is looked up by its stem: ASCII letters in lower case, without a
    full stop or comma that follows a letter, which the splitter cuts off. Known words and
    stems are kept in a table of a bounded size, which is emptied when it is full.
    """

    SEPARATOR = "<|endoftext|>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.token_to_id(self.SEPARATOR)
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.known = WordTable()
        self.marks = {0: b"", **{ord(m): self._ids(m).tobytes() for m in ",."}}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Many words in one call.

        A word of letters alone is one of the splitter's, and its last id, and no other, ends
        a word; such words are parted by spaces. Others are parted by a special token, which
        the tokenizer splits off before all else.
        """
        out, letters, others = {}, [], []
        for w in words:
            said = w.decode()
            if b"<|" in w:
                out[w] = self._ids(said).tobytes()
            else:
                (letters if said.isalpha() else others).append((w, said))
        for some, between in ((letters, " "), (others, self.SEPARATOR)):
            for at in range(0, len(some), 500):
                raw, said = zip(*some[at : at + 500], strict=True)
                ids = self._ids(between.join(said))
                ends = np.flatnonzero(self.last[ids]) + 1 if between == " " else None
                if ends is not None and len(ends) == len(raw):
                    cut, skip = ends * 4, 0
                else:  # a letter in lower case may be more than one
                    ids = self._ids(self.SEPARATOR.join(said)) if between == " " else ids
                    cut, skip = np.append(np.flatnonzero(ids == self.between), len(ids)) * 4, 4
                wide, cut = ids.tobytes(), cut.tolist()
                out.update(zip(raw, map(wide.__getitem__, map(slice, [0, *[c + skip for c in cut[:-1]]], cut)), strict=True))
        return out

    def _learn(self, words: list[bytes], h: np.ndarray) -> None:
        """Enter words that aren't known, and their stems."""
        split = [_stem(w) for w in words]
        stems = list({s for s, _ in split})
        data = np.frombuffer(b" ".join(stems) + bytes(8), np.uint8)
        size = np.array([len(s) for s in stems])
        starts = np.cumsum(size + 1) - size - 1
        sh = word_hashes(data, starts, starts + size)
        entry = self.known.find(sh, data, starts, size)
        ids = {stems[i]: self.known.ids_of(entry[i]) for i in np.flatnonzero(entry >= 0).tolist()}
        new = np.flatnonzero(entry < 0)
        some = [stems[i] for i in new.tolist()]
        made = self._encode_words(some)
        ids |= made
        self.known.put(some, sh[new], [made[s] for s in some])
        other = [i for i, (w, (s, _)) in enumerate(zip(words, split, strict=True)) if w != s]
        self.known.put([words[i] for i in other], h[other], [ids[split[i][0]] + self.marks[split[i][1]] for i in other])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and where each text's begin (one more at the end)."""
        known = self.known
        if known.full:
            known.clear()
        starts, ends, first = word_spans(data, offsets)
        h, size = word_hashes(data, starts, ends), ends - starts
        data = np.concatenate([data, np.zeros(8, np.uint8)])
        entry = known.find(h, data, starts, size)
        missing, lost = np.flatnonzero(entry < 0), []
        if len(missing):
            distinct, one = np.unique(h[missing], return_index=True)
            self._learn([data[starts[i] : ends[i]].tobytes() for i in missing[one].tolist()], distinct)
            entry[missing] = known.find(h[missing], data, starts[missing], size[missing])
            lost = missing[entry[missing] < 0].tolist()
        words = [data[starts[i] : ends[i]].tobytes() for i in lost]  # too long to keep, or of another's hash
        made = self._encode_words(list(set(words)))
        count = known.count[entry]
        count[lost] = [len(made[w]) // 4 for w in words]
        at = np.cumsum(count) - count
        if lost:
            ids, kept = np.empty(int(count.sum()), "<u4"), entry >= 0
            ids[ranges(at[kept], count[kept])] = known.ids[ranges(known.first[entry[kept]], count[kept])]
            for i, w in zip(lost, words, strict=True):
                ids[at[i] : at[i] + count[i]] = np.frombuffer(made[w], "<u4")
        else:
            ids = known.ids[ranges(known.first[entry], count)].astype("<u4")
        return ids, np.append(at, len(ids))[first]


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, pool_tokens: int = POOL_TOKENS, with_ids: bool = True) -> DataFrame:
    """Pack every document's ids, each followed by end_id, into sequences of at most capacity ids.

    Returns a row per piece: doc_id, start (the document's ids before it), length, ids_crc32
    (of its little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset (in its
    sequence) and ids (those bytes; null without with_ids). All sequences are full but for
    each input partition's last few, whose lengths are powers of two.

    A null text counts as empty and gives the end id alone; a null id stays null; repeated
    rows are packed as often as they occur; an empty table gives no rows. Other columns of
    docs are not read, so their names don't matter. Ids must be whole numbers. tokenizer_path is read on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the task's own: a global goes to each task by value, so it would be filled anew too, and freed only after memory is given back
        words, end = WordIds(tokenizer_path), np.array([end_id], "<u4").tobytes()
        packer = Packer(capacity, pool_tokens, (TaskContext.get().partitionId() << 36) if TaskContext.get() else 0, with_ids)
        for batch in batches:
            docs_here = batch.column(0).to_pylist()
            for first, data, at in pieces(batch.column(1), TOGETHER):
                ids, cut = words.encode(data, at)
                for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    packer.add(docs_here[first + k], ids[a:b].tobytes() + end)
                yield packer.batch()
        packer.finish()
        yield packer.batch()

    rows = docs.select(id_of(docs, id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
