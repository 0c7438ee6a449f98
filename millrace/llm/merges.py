"""Exact encoding with a merge-type piece model, and decoding.

The library's result is what merging neighbours gives, best score first and leftmost among
equals. A sequence of pieces is that result exactly when every two neighbours are: merging
the characters of both anew gives the two and not others. So a text needn't be merged at all.
From its start, the longest piece that matches (Aho-Corasick gives all matches in one pass) and
that agrees with the piece before it is taken; where none does, the last piece is given up
for the next shorter match, and its end is marked in a bitfield: the pieces up to a place are
determined by the place, so one that failed once always fails.

Texts are cut beforehand at places that no piece crosses, so the same words come again and
are remembered.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import quoted, tidy

SPACE = "▁"
#: Words that a Python worker remembers, about 80 MB, and their characters at most; when there are more words, all are forgotten. So with agreements of two pieces.
WORDS, WORD, PAIRS = 400_000, 64, 1_000_000
#: Characters of a text that are cut into words at a time.
CHARACTERS = 500_000
#: Characters whose matches are held at a time within one uncut run.
WINDOW = 4096
#: No piece. Characters of no piece are numbered downwards from here.
NONE = -1
NEVER = -float("inf")
#: Ids and characters that leave a task together, more only where one text has more.
TOGETHER = 4_000_000


class Encoder:
    """Encodes as the library does with a model of type BPE, byte fallback, identity normalization and no symbols of the user's; ValueError for others."""

    def __init__(self, path: str):
        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " aÄﬁ　  b\t① "
        if m.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model normalizes texts, which isn't built")
        n = m.get_piece_size()
        pieces = {m.id_to_piece(i): i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError("the model has no bytes to fall back to, which isn't built")
        if any(m.get_score(i) >= 0 for i in pieces.values()):
            raise ValueError("the model isn't of the merge type or has symbols of the user's, which isn't built")
        self.begin, self.end, self.known = m.bos_id(), m.eos_id(), n
        self.score = {p: m.get_score(i) for p, i in pieces.items()}
        self.alphabet = {c for p in pieces for c in p}
        for c in sorted(self.alphabet - pieces.keys()):  # a character that only longer pieces have stands for its bytes
            pieces[c] = n + len(pieces)
        self.text = {i: p for p, i in pieces.items()}
        self.widest = max(map(len, pieces))
        self.touch = {two for p in pieces for two in zip(p, p[1:])}
        self.size = [0] * (max(self.text) + 1)
        self.shorter = [NONE] * len(self.size)  # the next shorter piece that one begins with
        for p, i in pieces.items():
            self.size[i] = len(p)
            self.shorter[i] = next((pieces[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in pieces), NONE)
        self.find = ahocorasick.Automaton()
        for p, i in pieces.items():
            self.find.add_word(p, i)
        self.find.make_automaton()
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in self.alphabet)
        inner = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        one, others = (f"|[{alone}]", f"[^{alone}]") if alone else ("", "(?s:.)")
        self.cut = re.compile((f"{others}+" if inner else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+") + one)
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self._history: dict[int, tuple[list[float], list[str], list[str]] | None] = {}

    def history(self, piece: int) -> tuple[list[float], list[str], list[str]] | None:
        """Score of each merge that makes the piece from its characters, and its first and last part after it; None if merging makes something else."""
        if piece not in self._history:
            parts, score = list(self.text[piece]), self.score
            scores, firsts, lasts = [], [], []
            while len(parts) > 1:
                best, at = max(((score.get(parts[i] + parts[i + 1], NEVER), -i) for i in range(len(parts) - 1)))
                if best == NEVER:
                    break
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
                for column, x in zip((scores, firsts, lasts), (best, parts[0], parts[-1]), strict=True):
                    column.append(x)
            self._history[piece] = ([*scores, NEVER], firsts, lasts) if len(parts) == 1 else None
        return self._history[piece]

    def agree(self, left: int, right: int) -> bool:
        """Whether merging both pieces' characters gives these two: no merge across their border is ever the next one."""
        a, b = self.history(left), self.history(right)
        if a is None or b is None:
            return False
        (one, _, lasts), (two, firsts, _), score = a, b, self.score
        x, y, i, j = self.text[left][-1], self.text[right][0], 0, 0
        while True:
            s, t, across = one[i], two[j], score.get(x + y)
            if across is not None and across > s and across >= t:  # among equals the leftmost is next
                return False
            if s < t:
                y = firsts[j]
                j += 1
            elif s == NEVER:
                return True
            else:
                x = lasts[i]
                i += 1

    def _longest(self, run: str, base: int, to: int) -> list[int]:
        """The longest piece that begins at each place from base to to."""
        found, size = [NONE] * (to - base), self.size
        for end, piece in self.find.iter(run, base, min(to + self.widest, len(run))):
            at = end - size[piece] + 1 - base
            if at < to - base:
                found[at] = piece  # matches come by their ends, so the last one is the longest
        return found

    def pieces(self, run: str) -> list[int]:
        """Pieces of a run: ids, those of characters without a piece beyond all ids, and NONE - 1 - code for characters of no piece."""
        n, out, pos, before = len(run), [], 0, NONE
        base, to = 0, min(WINDOW, n)
        longest, pairs, size, shorter = self._longest(run, base, to), self.pairs, self.size, self.shorter
        failed: bytearray | None = None
        piece = longest[0]
        while True:
            while piece != NONE:
                end = pos + size[piece]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if before < 0:
                        fits = self.history(piece) is not None
                    else:
                        fits = pairs.get(before << 24 | piece)
                        if fits is None:
                            if len(pairs) >= PAIRS:
                                pairs.clear()
                            fits = pairs[before << 24 | piece] = self.agree(before, piece)
                    if fits:
                        break
                piece = shorter[piece]
            else:
                end = pos + 1
                if longest[pos - base] == NONE and (failed is None or not failed[end >> 3] >> (end & 7) & 1):
                    piece = NONE - 1 - ord(run[pos])
                else:  # back to the piece before, and from it to a shorter one
                    failed = failed or bytearray((n >> 3) + 1)
                    failed[pos >> 3] |= 1 << (pos & 7)
                    last = out.pop()
                    pos -= size[last] if last >= 0 else 1
                    before, piece = out[-1] if out else NONE, shorter[last] if last >= 0 else NONE
                    if pos < base:
                        base, to = pos // WINDOW * WINDOW, min(pos // WINDOW * WINDOW + WINDOW, n)
                        longest = self._longest(run, base, to)
                    continue
            out.append(piece)
            pos, before = end, piece
            if pos == n:
                return out
            if pos >= to:
                base, to = pos // WINDOW * WINDOW, min(pos // WINDOW * WINDOW + WINDOW, n)
                longest = self._longest(run, base, to)
            piece = longest[pos - base]

    def _run(self, run: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces(run):
            if 0 <= piece < self.known:
                ids.append(piece)
            else:
                ids += [self.bytes[x] for x in (self.text[piece] if piece >= 0 else chr(NONE - 1 - piece)).encode()]
        return self._kept(run, struct.pack(f"<{len(ids)}I", *ids))

    def _kept(self, run: str, ids: bytes) -> bytes:
        if len(run) <= WORD:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[run] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Of a word that isn't remembered: cut where no piece has the two characters that meet, its runs may be."""
        touch, at, known, out = self.touch, 0, self.words, []
        for i, two in enumerate(zip(word, word[1:]), 1):
            if two not in touch:
                run, at = word[at:i], i
                out.append(known.get(run) or self._run(run))
        run = word[at:]
        out.append(known.get(run) or self._run(run))
        return out[0] if len(out) == 1 else self._kept(word, b"".join(out))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, with begin and end."""
        out, known = [struct.pack("<I", self.begin)], self.words
        if text:
            text = SPACE + text.replace(" ", SPACE)
            if len(text) <= CHARACTERS:
                out += [known.get(w) or self._word(w) for w in self.cut.findall(text)]
            else:  # a list of all its words would be many times the text
                some: list[bytes] = []
                for found in self.cut.finditer(text):
                    w = found[0]
                    some.append(known.get(w) or self._word(w))
                    if len(some) >= CHARACTERS:
                        out.append(b"".join(some))
                        some.clear()
                out += some
        out.append(struct.pack("<I", self.end))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One a Python worker and model, with its words, over all its tasks."""
    return Encoder(path)


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, with begin and end) and decoded (their text; null unless asked for).

    model: a path that every worker can open. A null text is an empty one, whose ids are
    begin and end alone. Texts of any length are encoded whole. Rows stay as they are: null
    ids, repeated rows, and no row for an empty table. Other columns are not read.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for b in batches:
            ids: list[bytes] = []
            texts: list[str | None] = []
            first = size = 0

            def made(to: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0).slice(first, to - first), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])  # noqa: B023  used at once

            for i, text in enumerate(b.column(1)):
                ids.append(own.encode(text.as_py() or ""))
                texts.append(own.decode(ids[-1]) if decoded else None)
                size += len(ids[-1]) + len(texts[-1] or "")
                if size >= TOGETHER:
                    yield made(i + 1)
                    ids, texts, first, size = [], [], i + 1, 0
            yield made(len(b))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, ids binary, decoded string")
