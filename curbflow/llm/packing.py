"""Packing documents into sequences: best fit, then swap-based local search.

Only lengths matter for the packing, and there are at most as many as a sequence has tokens. So the plan is made on the
histogram of lengths: classes of equal sequences, each a multiset of lengths with a multiplicity. Best fit decreasing
builds the classes; local search then exchanges one document for one, two for one, or moves one between underfull
sequences, always raising the sum of squared fills, until sequences empty. Its cost does not depend on the number of
documents. Every document gets its place by its rank among those of its length, which is counted in salted groups.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import Store, prepare, slices, table

CAPACITY = 1024
END_ID = 2
#: Steps that the local search takes at most, and pairs of classes it looks at for each.
STEPS, PAIRS = 400, 4000
#: Pieces of a length for each salt of the ranking.
SALT_ROWS = 50_000

#: Blanks in a row that are merged by themselves, if the pattern's matcher can't take a text.
LONG_RUN = 10_000
#: Unicode's white space.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]++")

Classes = list[tuple[Counter, int]]


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Classes:
    """Best fit decreasing over a histogram {length: count}: classes of sequences (lengths, multiplicity)."""
    free: dict[int, list[tuple[Counter, int]]] = defaultdict(list)
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        for room in range(length, capacity):
            while left and free[room]:
                # The fullest fitting sequence stays the fullest while it has room, so it takes copies until it has none.
                own, many = free[room].pop()
                each = min(left, room // length)
                used = min(left // each, many)
                if many > used:
                    free[room].append((own, many - used))
                free[room - each * length].append((own + Counter({length: each}), used))
                left -= each * used
            if not left:
                break
        each = capacity // length
        if left >= each:
            free[capacity - each * length].append((Counter({length: each}), left // each))
        if left % each:
            free[capacity - left % each * length].append((Counter({length: left % each}), 1))
    return [x for room in sorted(free) for x in free[room] if x[1]]


def fill(own: Counter) -> int:
    return sum(n * c for n, c in own.items())


def best_exchange(a: Counter, b: Counter, capacity: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
    """The exchange between a sequence of a and one of b that raises the squared fill most: (gain, from a, from b)."""
    room, lead = capacity - fill(a), fill(a) - fill(b)
    give = [(0, ())] + [(x, (x,)) for x in a]
    pair_a = [(x + y, (x, y)) for x in a for y in a if x < y or x == y and a[x] > 1]
    pair_b = [(x + y, (x, y)) for x in b for y in b if x < y or x == y and b[x] > 1]
    single_b = [(y, (y,)) for y in b]
    best = None
    for ours, theirs in ((give, single_b), (give[1:], pair_b), (pair_a, single_b)):
        for s, x in ours:
            for t, y in theirs:
                shift = t - s
                if 0 < shift <= room and (gain := 2 * shift * (lead + shift)) > 0 and (best is None or (gain, x, y) > best):
                    best = (gain, x, y)
    return best


def improve(classes: Classes, capacity: int = CAPACITY, steps: int = STEPS) -> Classes:
    """Local search among underfull sequences. Classes act as one: an exchange is made by all pairs of two classes."""
    total = sum(fill(own) * many for own, many in classes)
    counts: dict[tuple, int] = defaultdict(int)
    for own, many in classes:
        counts[tuple(sorted(own.items()))] += many
    least = -(-total // capacity)
    for _ in range(steps):
        if sum(counts.values()) <= least:
            break
        under = sorted((k for k in counts if fill(Counter(dict(k))) < capacity), key=lambda k: (fill(Counter(dict(k))), k))
        looked, made = 0, False
        for low in under:  # the emptiest sequences are to be emptied, the fullest filled first
            for high in reversed(under):
                looked += 1
                if looked > PAIRS:
                    break
                if high == low and counts[low] < 2:
                    continue
                a, b = Counter(dict(high)), Counter(dict(low))
                if fill(a) < fill(b) or not (move := best_exchange(a, b, capacity)):
                    continue
                many = counts[low] // 2 if high == low else min(counts[high], counts[low])
                x, y = Counter(move[1]), Counter(move[2])
                for key in (high, low):
                    counts[key] -= many
                    if not counts[key]:
                        del counts[key]
                for new in (a - x + y, b - y + x):
                    if new:
                        counts[tuple(sorted(new.items()))] += many
                made = True
                break
            if made or looked > PAIRS:
                break
        if not made:
            break
    return [(Counter(dict(k)), n) for k, n in sorted(counts.items())]


def places(classes: Classes) -> dict[int, tuple[np.ndarray, ...]]:
    """Length -> intervals of ranks: (first rank, first sequence, copies in a sequence, offset of the first copy)."""
    taken: dict[int, int] = defaultdict(int)
    rows: dict[int, list] = defaultdict(list)
    number = 0
    for own, many in classes:
        at = 0
        for length in sorted(own, reverse=True):
            rows[length].append((taken[length], number, own[length], at))
            taken[length] += own[length] * many
            at += own[length] * length
        number += many
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}


class Tokens:
    """Ids of whole texts by a byte-level BPE vocabulary in the `tokenizers` library's JSON format.

    The ids are those of that library, special tokens' strings in a text included; merging is done by tiktoken, whose
    ranks are the ids, since this vocabulary numbers its pieces in the order of their merges.
    """

    #: How this vocabulary splits a text before merging.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        file = json.loads(Path(path).read_text("utf-8"))
        special = {x["content"]: x["id"] for x in file["added_tokens"]}
        # Printable bytes stand for themselves; the others, in order, are written as the characters from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in file["model"]["vocab"].items() if piece not in special}
        self.coder = tiktoken.Encoding("vocabulary", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = special
        self.named = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids as little-endian 32-bit numbers."""
        return [self.ids(t).astype("<u4").tobytes() for t in texts]

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.coder.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the pattern's matcher gives up on about a million blanks in a row
            return np.concatenate([np.empty(0, dtype=np.uint32), *self.parts(text)])

    def parts(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text with long runs of blanks, which the pattern takes as one piece, but for the last before more."""
        for part in self.named.split(text) if self.named else [text]:
            if part in self.special:
                yield np.array([self.special[part]], dtype=np.uint32)
                continue
            at = 0
            for run in _BLANKS.finditer(part):
                end = run.end() - (run.end() < len(part))
                if end - run.start() >= LONG_RUN:
                    yield self.coder.encode_to_numpy(part[at : run.start()], disallowed_special=())
                    yield np.array(self.coder._encode_single_piece(part[run.start() : end]), dtype=np.uint32)
                    at = end
            yield self.coder.encode_to_numpy(part[at:], disallowed_special=())


@cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cutter(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], dtype="<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                ids = batch.column("doc_id").to_pylist()
                for doc, line in zip(ids, tokens(path).encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                    line += end
                    n = len(line) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    rows += [(doc, i, a, b - a, zlib.crc32(line[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Places for all pieces of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and END_ID; null and empty texts are END_ID alone. Longer ones are cut into pieces of
    the capacity, of which the first may be shorter. Repeated rows are packed as often as they occur, rows without
    doc_id like any other. An empty table gives no rows. Other columns are ignored.
    path: a tokenizer file that every executor has.
    """
    spark = prepare(docs.sparkSession)
    store = Store(spark)
    cut = store.put(docs.select("doc_id", "text").mapInArrow(cutter(path or vocabulary(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    table_of = places(improve(best_fit(histogram, capacity), capacity))

    salts = max(16, sum(histogram.values()) // SALT_ROWS)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = salted.withColumn("inner", inner).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("inner") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(at):
                    n = int(length[at[0]])
                    first, number, copies, start = table_of[n]
                    k = np.searchsorted(first, rank[at], side="right") - 1
                    inside = rank[at] - first[k]
                    sequence[at] = number[k] + inside // copies[k]
                    offset[at] = start[k] + inside % copies[k] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
