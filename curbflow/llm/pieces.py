"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, with byte fallback.

Vocabulary files are read, never trained. Pieces of a unigram file carry log probabilities; those of a BPE file carry
only their rank, which Zipf's law turns into one: log p = -log(rank + 1) - log(sum of 1/r).

A text becomes segments: a run of whitespace marks and what follows up to the next mark. No piece crosses from a
segment into the next, so the best segmentation of a text is that of its segments, and each distinct segment is solved
once. Distinct segments of a batch are solved together, one position at a time, by vectorised trie steps.

Long segments (text without blanks) are cut further: the trie runs from all positions at once, and where no piece that
begins before a position ends after it, the two sides are independent. What is still long is walked through piece by piece.
A vocabulary whose pieces hold marks after other characters makes a text one long segment.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import annotate, table

MARK = "▁"
_MARK = MARK.encode()
#: Stands for a mark that the text itself holds, which must not become a space: a byte that no UTF-8 text has.
_OWN = b"\xff"
#: Kinds of pieces in the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Steps of a score to one; the file's own numbers are no finer.
GRID = 1 << 24
#: An unknown character costs so much more than the worst piece.
PENALTY = 10.0
#: Segments that a task remembers at a time, the longest one in bytes that is solved with others, and those solved together.
REMEMBERED, LONG, TOGETHER = 300_000, 64, 8192
#: Positions of a long segment that the trie runs from at a time.
POSITIONS = 1 << 16


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """Fields of a message in the protocol-buffer wire format: (number, value)."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def read_model(path: str) -> tuple[list[tuple[bytes, float, int]], bool]:
    """Pieces (text, score, kind) in order of their ids, and whether the scores are BPE ranks."""
    pieces, ranked = [], False
    for number, value in _fields(Path(path).read_bytes()):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b""), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            ranked = dict(_fields(value)).get(3, 1) == 2
    return pieces, ranked


#: Length of the character that a byte begins; 0 inside one.
_LEAD = np.array([1] * 0x80 + [0] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 8 + [1] * 8, dtype=np.int32)


def mark(segment: bytes) -> bytes:
    """A segment with marks for its spaces."""
    return segment.replace(_MARK, _OWN).replace(b" ", _MARK)


class DoubleArray:
    """A trie over byte strings in two arrays: the child of state s by byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in keys:
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][c]
            value[node] = v
        size = len(children) + 4096
        self.base = np.zeros(size, dtype=np.int32)
        self.check = np.full(size, -1, dtype=np.int32)
        self.value = np.full(size, -1, dtype=np.int32)
        free = np.ones(size, dtype=bool)
        free[0] = False
        places, low = {0: 0}, 1
        queue = [0]
        for node in queue:
            own = sorted(children[node])
            queue.extend(children[node][c] for c in own)
            if not own:
                continue
            low += int(free[low:].argmax())
            at, offsets = max(low, own[0] + 1), [c - own[0] for c in own]
            while True:
                if at + 2048 >= len(free):
                    grow = len(free)
                    self.base, self.check, self.value = (np.concatenate([x, np.full(grow, f, dtype=np.int32)]) for x, f in ((self.base, 0), (self.check, -1), (self.value, -1)))
                    free = np.concatenate([free, np.ones(grow, dtype=bool)])
                fits = free[at : at + 1024].copy()
                for o in offsets[1:]:
                    fits &= free[at + o : at + o + 1024]
                if fits.any():
                    at += int(fits.argmax())
                    break
                at += 1024
            self.base[places[node]] = at - own[0] - 1
            for c in own:
                slot = at + c - own[0]
                free[slot] = False
                self.check[slot] = places[node]
                self.value[slot] = value[children[node][c]]
                places[children[node][c]] = slot
        self.base, self.check, self.value = (np.concatenate([x, np.full(512, f, dtype=np.int32)]) for x, f in ((self.base, 0), (self.check, -1), (self.value, -1)))

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children by these bytes, and which of them exist."""
        slot = self.base[state] + byte + 1
        return slot, self.check[slot] == state


class Unigram:
    def __init__(self, path: str):
        pieces, ranked = read_model(path)
        self.texts = [p[0] for p in pieces]
        self.kinds = [p[2] for p in pieces]
        normal = [i for i, p in enumerate(pieces) if p[2] in (NORMAL, USER)]
        scores = np.array([p[1] for p in pieces])
        if ranked:
            order = sorted(normal, key=lambda i: (-scores[i], i))
            rank = np.arange(1, len(order) + 1)
            scores[order] = -np.log(rank) - np.log((1 / rank).sum())
        # To a grid on which sums are exact, so that ties are ties in whatever order pieces are added.
        self.scores = scores = np.round(scores * GRID) / GRID
        self.trie = DoubleArray([(self.texts[i], i) for i in normal])
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.unknown_score = float(scores[normal].min()) - PENALTY
        self.bytes = {int(self.texts[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        crossing = re.compile(b"[^\x81]" + _MARK + b"|(?<!\xe2\x96)\x81" + _MARK)
        #: Whether segments can be solved alone.
        self.separable = not any(crossing.search(self.texts[i]) for i in normal)
        self.plain = [int(t[3:5], 16).to_bytes() if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else t.replace(_MARK, b" ") for t, k in zip(self.texts, self.kinds, strict=True)]
        self.known: dict[bytes, tuple[int, ...]] = {}

    def segments(self, text: bytes) -> list[bytes]:
        """The text with a space before it (spaces stand for marks), cut before each run of spaces."""
        if not text:
            return []
        return re.findall(rb" +[^ ]*", b" " + text) if self.separable else [b" " + text]

    def solve(self, marked: list[bytes]) -> list[tuple[int, ...]]:
        """Best ids of each segment (with its marks), all segments together: a forward pass over start positions, then back."""
        size = np.array([len(s) for s in marked])
        width = int(size.max())
        line = np.frombuffer(b"".join(s.ljust(width + 1, b"\0") for s in marked), dtype=np.uint8).reshape(len(marked), width + 1).astype(np.int32)
        best = np.full(line.shape, -np.inf)
        best[:, 0] = 0
        back, by = np.zeros(line.shape, dtype=np.int32), np.full(line.shape, -1, dtype=np.int32)
        lead = _LEAD[line]
        for start in range(width):
            rows = np.flatnonzero((size > start) & (best[:, start] > -np.inf))
            if not len(rows):
                continue
            own, state, at = rows, np.zeros(len(rows), dtype=np.int32), start
            char = lead[rows, start]
            single = np.zeros(len(marked), dtype=bool)
            while len(own):
                state, there = self.trie.step(state, line[own, at])
                there &= at < size[own]
                own, state, at = own[there], state[there], at + 1
                piece = self.trie.value[state]
                found = piece >= 0
                if found.any():
                    r, p = own[found], piece[found]
                    single[r[at - start == lead[r, start]]] = True
                    score = best[r, start] + self.scores[p]
                    better = score > best[r, at]
                    r, p = r[better], p[better]
                    best[r, at], back[r, at], by[r, at] = score[better], start, p
            lone = ~single[rows]
            r, n = rows[lone], np.maximum(1, char[lone])
            end = np.minimum(start + n, size[r])
            score = best[r, start] + self.unknown_score
            better = score > best[r, end]
            r, end = r[better], end[better]
            best[r, end], back[r, end], by[r, end] = score[better], start, self.unknown
        return [self.back(m, b, p) for m, b, p in zip(marked, back, by, strict=True)]

    def back(self, marked: bytes, starts: np.ndarray, used: np.ndarray) -> tuple[int, ...]:
        """The ids on the best way to the end; starts and used: where the last piece before each position begins, and its id."""
        ids: list[int] = []
        starts, used, n = starts.tolist(), used.tolist(), len(marked)
        while n:
            start, piece = starts[n], used[n]
            if piece == self.unknown and self.bytes:
                ids.extend(self.bytes[c] for c in reversed(marked[start:n].replace(_OWN, _MARK)))
            else:
                ids.append(piece)
            n = start
        return tuple(reversed(ids))

    def learn(self, segments: set[bytes]) -> None:
        """Solves those short segments that are not remembered, in groups of about one length."""
        if len(self.known) + len(segments) > REMEMBERED:
            self.known.clear()
        new = sorted((s for s in segments if s not in self.known), key=lambda s: (len(s), s))
        for at in range(0, len(new), TOGETHER):
            self.known.update(zip(new[at : at + TOGETHER], self.solve(list(map(mark, new[at : at + TOGETHER]))), strict=True))

    def matches(self, line: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of start positions, and (starts, ends, pieces) of all pieces that begin there: (low, high, ...)."""
        for low in range(0, len(line), POSITIONS):
            high = min(len(line), low + POSITIONS)
            start = low + np.flatnonzero(_LEAD[line[low:high]])
            state, depth, found = np.zeros(len(start), dtype=np.int32), 0, []
            while len(start):
                inside = start + depth < len(line)
                start, state = start[inside], state[inside]
                state, there = self.trie.step(state, line[start + depth])
                start, state, depth = start[there], state[there], depth + 1
                piece = self.trie.value[state]
                hit = piece >= 0
                found.append((start[hit], start[hit] + depth, piece[hit]))
            yield low, high, *(np.concatenate([x[k] for x in found]) if found else np.empty(0, dtype=np.int64) for k in range(3))

    def cut(self, marked: bytes) -> list[bytes]:
        """A long segment cut wherever no piece crosses."""
        line = np.frombuffer(marked, dtype=np.uint8).astype(np.int32)
        reach = np.arange(len(line)) + _LEAD[line]
        for _, _, start, end, _ in self.matches(line):
            np.maximum.at(reach, start, end)
        free = np.flatnonzero((np.maximum.accumulate(reach)[:-1] <= np.arange(1, len(line))) & (_LEAD[line[1:]] > 0)) + 1
        return [marked[a:b] for a, b in zip([0, *free.tolist()], [*free.tolist(), len(line)], strict=True)]

    def walk(self, marked: bytes) -> tuple[int, ...]:
        """Best ids of a segment that can't be cut, piece by piece."""
        line = np.frombuffer(marked, dtype=np.uint8).astype(np.int32)
        best = array("d", [-np.inf]) * (len(line) + 1)
        back, by = (array("i", [-1]) * (len(line) + 1) for _ in range(2))
        best[0] = 0.0
        for low, high, start, end, piece in self.matches(line):
            own = low + np.flatnonzero(_LEAD[line[low:high]])
            whole = start[end - start == _LEAD[line[start]]]
            lone = np.setdiff1d(own, whole, assume_unique=True)
            start = np.concatenate([start, lone])
            end = np.concatenate([end, np.minimum(lone + _LEAD[line[lone]], len(line))])
            score = np.concatenate([self.scores[piece], np.full(len(lone), self.unknown_score)])
            piece = np.concatenate([piece, np.full(len(lone), self.unknown, dtype=piece.dtype)])
            order = np.argsort(start, kind="stable")
            for a, b, gain, p in zip(*(x[order].tolist() for x in (start, end, score, piece)), strict=True):
                reached = best[a] + gain
                if reached > best[b]:
                    best[b], back[b], by[b] = reached, a, p
        return self.back(marked, np.frombuffer(back, dtype=np.int32), np.frombuffer(by, dtype=np.int32))

    def solve_long(self, segment: bytes) -> list[int]:
        parts = [p.replace(_MARK, b" ").replace(_OWN, _MARK) for p in self.cut(mark(segment))]
        self.learn({p for p in parts if len(p) <= LONG})
        return [i for p in parts for i in (self.known[p] if len(p) <= LONG else self.walk(mark(p)))]

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of whole texts. An empty text has none."""
        cut = [self.segments(t) for t in texts]
        every = set().union(*cut)
        solved: dict = {s: self.solve_long(s) for s in every if len(s) > LONG}
        self.learn({s for s in every if len(s) <= LONG})
        known = self.known
        if solved:
            return [[i for s in own for i in (known[s] if len(s) <= LONG else solved[s])] for own in cut]
        return [[i for s in own for i in known[s]] for own in cut]

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids: marks become spaces, byte pieces their bytes, and a mark that begins the first piece goes."""
        text = b"".join(map(self.plain.__getitem__, ids))
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if first is not None and self.kinds[first] != BYTE and self.texts[first].startswith(_MARK) else text


@cache
def model(path: str) -> Unigram:
    return Unigram(path)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, passed: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those passed) with piece_ids array<int>.

    path: a vocabulary file that every executor has. Null and empty texts have no ids. Texts are encoded whole, as they
    are: no normalisation besides whitespace marks. Repeated rows encode alike; an empty table gives no rows.
    """
    path = path or vocabulary()
    return annotate(docs, lambda texts: [model(path).encode([t or b"" for t in texts])], "piece_ids array<int>", passed)


def decode(rows: DataFrame, path: str | None = None, column: str = "piece_ids") -> DataFrame:
    """rows with decoded, the text of the ids. Null ids give null; bytes that are no UTF-8 become U+FFFD."""
    path = path or vocabulary()

    @F.pandas_udf("string")
    def texts(ids):
        import pandas as pd

        return pd.Series([None if x is None else model(path).decode(list(x)).decode("utf-8", "replace") for x in ids])

    return rows.withColumn("decoded", texts(column))


def op5_pieces(spark, sf_dir: str) -> DataFrame:
    """Every document's encoding in digest: its ids' number, checksum and fallback bytes, and whether they decode to it."""
    path = vocabulary()

    def digest(texts: list[bytes | None]) -> list:
        pieces = model(path)
        own = [t or b"" for t in texts]
        ids = pieces.encode(own)
        low, high = min(pieces.bytes.values(), default=-1), max(pieces.bytes.values(), default=-2)
        lines = [np.array(x, dtype="<u4") for x in ids]
        return [[len(x) for x in ids], [zlib.crc32(x.tobytes()) for x in lines], [int(((x >= low) & (x <= high)).sum()) for x in lines], [pieces.decode(x) == t for x, t in zip(ids, own, strict=True)]]

    found = annotate(table(spark, sf_dir, "documents"), digest, "n_pieces long, ids_crc32 long, n_bytes long, round_trip boolean", ["doc_id", "text"])
    return found.drop("text")
