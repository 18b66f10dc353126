"""Near-duplicate documents: SimHash fingerprints linked by covering locality-sensitive hashing.

For a radius r, bit positions are dealt over the non-zero vectors of r+1 bits. Each non-zero vector v gives a mask that
keeps the positions whose vector has an odd inner product with v. Any r positions leave some v orthogonal to all of
them, so two fingerprints that differ in r bits or fewer agree on all kept bits of at least one of the 2^(r+1)-1 masks:
every such pair shares a bucket of some table, and none is missed.

Buckets are compared inside a task and return a spanning forest of their links, never all pairs. A bucket of more than
BUCKET distinct fingerprints is dealt again by a second family of masks on top of its own (then a third ...): the same
guarantee holds within it, and each family halves the bits that may still differ, which bounds every bucket.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import Store, annotate, binary, columns, prepare, slices, table, unused
from curbflow.llm.components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Distinct fingerprints that one bucket may hold before it is dealt by further masks.
BUCKET = 4096
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of word shingles, counted as often as they occur; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends[: len(words) - SHINGLE + 1] - lengths[: len(words) - SHINGLE + 1] + 1
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)), dtype="<u8", count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            found = np.fromiter(map(fingerprint, binary(batch.column("text"))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def masks(radius: int, level: int, bits: int = 64) -> list[int]:
    """The covering family of a level, as unsigned masks; levels differ in how positions are dealt to vectors."""
    places = list(range(bits))
    random.Random(1000 + level).shuffle(places)
    vectors = (1 << radius + 1) - 1
    vector = {place: i % vectors + 1 for i, place in enumerate(places)}
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: each one found, and the first of its tree."""
    found, roots, rest = [], [], values
    while len(rest) > 1:
        root, frontier, rest = rest[0], [rest[0]], rest[1:]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= radius
            if near.any():
                hits, rest = rest[near], rest[~near]
                found.append(hits)
                roots.append(np.full(len(hits), root))
                frontier.extend(hits)
    none = np.empty(0, dtype=np.uint64)
    return np.concatenate([none, *found]), np.concatenate([none, *roots])


def compare(radius: int, most: int):
    """Task side: rows (way, key, fp) sorted by bucket -> links (hot false), or the rows of buckets over `most` (hot true)."""

    def out(hot: bool, way, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), pa.array(way), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["hot", "way", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way, key, fp = (np.empty(0, dtype=np.int64) for _ in range(3))
        over = None  # the bucket that is being passed on, if any
        for batch in batches:
            way, key, fp = (np.concatenate([old, batch.column(c).to_numpy()]) for old, c in ((way, "way"), (key, "key"), (fp, "fp")))
            first = np.flatnonzero(np.concatenate([[True], (way[1:] != way[:-1]) | (key[1:] != key[:-1])]))
            size = np.diff(np.append(first, len(fp)))
            if over is not None:
                if (way[0], key[0]) == over:
                    yield out(True, way[: size[0]], fp[: size[0]], fp[: size[0]])
                    if len(first) == 1:
                        way, key, fp = way[:0], key[:0], fp[:0]
                        continue
                    way, key, fp, first, size = way[size[0] :], key[size[0] :], fp[size[0] :], first[1:] - size[0], size[1:]
                over = None
            if size[-1] > most:
                over = (way[-1], key[-1])
            yield from whole(way, fp, first[:-1], size[:-1])
            at = first[-1]
            if over is not None:
                yield out(True, way[at:], fp[at:], fp[at:])
                way, key, fp = way[:0], key[:0], fp[:0]
            else:
                way, key, fp = way[at:], key[at:], fp[at:]
        if len(fp):
            yield from whole(way, fp, np.array([0]), np.array([len(fp)]))

    def whole(way: np.ndarray, fp: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits = fp.view(np.uint64)
        for at, n in zip(first[size > most].tolist(), size[size > most].tolist(), strict=True):
            yield out(True, way[at : at + n], bits[at : at + n], bits[at : at + n])
        two = first[size == 2]
        two = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= radius]
        links = [(bits[two + 1], bits[two])]
        several = (size > 2) & (size <= most)
        links += [bucket_links(bits[at : at + n], radius) for at, n in zip(first[several].tolist(), size[several].tolist(), strict=True)]
        a, b = (np.concatenate([x[k] for x in links]) for k in (0, 1))
        if len(a):
            yield out(False, np.zeros(len(a), dtype=np.int64), a, b)

    return run


def links(distinct: DataFrame, store: Store, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp) whose components are those of all pairs within the radius."""
    tables = (1 << radius + 1) - 1
    rows = distinct.select(F.lit(0).cast("long").alias("way"), "fp")
    found, level = None, 0
    while True:
        dealt = rows.withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).withColumn("way", F.col("way") * tables + F.col("table"))
        mask = F.lit(0).cast("long")  # of the tables taken so far, which are the digits of way
        for k in range(level + 1):
            digit = (F.floor(F.col("way") / tables ** (level - k)) % tables + 1).cast("int")
            mask = mask.bitwiseOR(F.element_at(F.array(*[F.lit(signed(m)) for m in masks(radius, k)]), digit))
        dealt = dealt.withColumn("key", F.col("fp").bitwiseAND(mask)).repartition("way", "key").sortWithinPartitions("way", "key", "fp")
        result = store.put(dealt.select("way", "key", "fp").mapInArrow(compare(radius, most), "hot boolean, way long, a long, b long"))
        new = result.filter(~F.col("hot")).select("a", "b")
        found = new if found is None else found.union(new)
        rows = result.filter("hot").select("way", F.col("a").alias("fp"))
        level += 1
        if rows.isEmpty():
            return found


def classes(docs: DataFrame, store: Store, radius: int = RADIUS, most: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, label, component_id) of every fingerprint; label is one of its group."""
    prints = store.put(docs.select("doc_id", "text").mapInArrow(fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long"))
    distinct = store.put(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    inner = Store(store.spark)
    labels = components(links(distinct.select("fp"), inner, radius, most), inner).withColumnRenamed("node", "fp")
    named = store.put(distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    inner.close()
    store.drop(distinct)
    ids = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return prints, named.select("fp", "label").join(ids, "label").select("fp", "label", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text); fp is the fingerprint as a signed long.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Equal fingerprints, repeated rows
    among them, are handled as one: they are linked without pairs. A row without doc_id is linked too but names no
    component; a component of such rows only has a null id. An empty table gives no rows. Other columns are ignored.
    """
    prints, by_print = classes(docs, Store(prepare(docs.sparkSession)), radius, most)
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates: of the rows with its smallest doc_id, the first by text.

    Groups without any doc_id keep a row too, of the others rows without doc_id go. Where rows of one id lie in several
    groups that it names, each of these keeps a row. Of rows with equal texts the first by their other columns stays.
    Columns of docs stay as they are, whatever their names.
    """
    store = Store(prepare(docs.sparkSession))
    prints, by_print = classes(docs, store)
    heads = F.count_if(F.col("doc_id").eqNullSafe(F.col("component_id")))
    named = store.put(prints.join(by_print, "fp").groupBy("doc_id").agg(F.count("*").alias("n"), heads.alias("heads")).filter("heads > 0"))
    one, fields = F.col("doc_id").isNotNull() & (F.col("n") == 1), columns(docs.columns)
    several = named.filter("doc_id IS NOT NULL AND n > 1").select("doc_id")
    # The kept ids grow with the corpus, so they are never broadcast; hashing them spares a sort of the texts.
    out = docs.join(named.filter(one).select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(fields)
    if named.filter(~one).isEmpty():
        return out
    # The fingerprints of rows that their id does not tell apart say which group each one is of.
    fp, label, component, row = (unused(docs, x) for x in ("fp", "label", "component", "row"))
    rest = docs.join(several, "doc_id", "left_semi").select(fields).unionByName(docs.filter(F.col("doc_id").isNull()))
    rest = annotate(rest, lambda texts: [[signed(fingerprint(t)) for t in texts]], f"{fp} long")
    groups = by_print.select(F.col("fp").alias(fp), F.col("label").alias(label), F.col("component_id").alias(component))
    rest = rest.join(groups, fp).filter(F.col("doc_id").eqNullSafe(F.col(component)))
    first = F.min_by(F.struct(fields), F.struct("text", F.to_json(F.struct(fields))))
    return out.unionByName(rest.groupBy("doc_id", label).agg(first.alias(row)).select(f"{row}.*"))
