"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a 60-bit key hash. All rows start in one bucket; a bucket whose rows
exceed the byte limit, and only such a bucket, is split on its next bit, until every bucket fits.

Distributed form: byte sums of a fine level of prefixes are aggregated once, rolled up to every coarser level, and a
shard is the shortest prefix that fits below a parent that doesn't. Prefixes of the fine level that are still too large
are refined with more bits, in rounds over the histogram's offending cells only. Equal hashes cannot be split by bits;
if rows of one hash exceed the limit they fill a chain of overflow pages.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import Store, table

BITS = 60
#: Bytes of text in a shard, at most.
SHARD_BYTES = 1 << 20
#: Rows of the largest hash for each salt of its overflow pages' numbering.
SALT_ROWS = 50_000
#: Bits of the first histogram beyond those that evenly spread bytes would need.
EXTRA_BITS = 4


def key_hash(column):
    """60 bits of the MD5 of the key as text: the same in every SQL engine. A null key hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(h, depth):
    return F.call_function("shiftright", h, F.lit(BITS) - depth)


def first_level(total: int, limit: int) -> int:
    """Bits of the first histogram: its cells are a fixed multiple of the shards that evenly spread bytes would need."""
    return min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + EXTRA_BITS)


def directory(hashes: DataFrame, limit: int, total: int) -> DataFrame:
    """Leaf buckets (depth, prefix, n_rows, n_bytes) of hashes (h, n_rows, n_bytes).

    Every leaf fits the limit or holds a single hash. The leaves' prefixes cover the hash space without overlap.
    """
    fine = first_level(total, limit)
    found, low, parents = None, 0, None
    while True:
        cells = hashes if parents is None else hashes.join(parents, prefix(F.col("h"), F.col("at")) == F.col("cell"), "left_semi")
        cells = cells.groupBy(prefix(F.col("h"), F.lit(fine)).alias("leaf")).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
        levels = (
            cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(fine))).alias("depth"))
            .groupBy("depth", F.call_function("shiftright", F.col("leaf"), F.lit(fine) - F.col("depth")).alias("prefix"))
            .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
        )
        large = levels.filter(F.col("n_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        keep = (F.col("n_bytes") <= limit) | (F.col("depth") == BITS)
        # at the first level of a round the parent is known to be too large (or there is none)
        top = levels.filter((F.col("depth") == low) & keep)
        below = levels.filter((F.col("depth") > low) & keep).withColumn("parent", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
        leaves = top.unionByName(below.join(large, ["depth", "parent"], "left_semi").drop("parent"))
        found = leaves if found is None else found.unionByName(leaves)
        over = levels.filter((F.col("depth") == fine) & ~keep).select(F.lit(fine).alias("at"), F.col("prefix").alias("cell"))
        if fine == BITS or over.isEmpty():
            return found
        parents, low, fine = over, fine + 1, min(BITS, fine + 12)


def shard(df: DataFrame, key: str, size, limit: int = SHARD_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Assigns every row to a shard. Returns key, the kept columns, n_bytes, depth, prefix, page, shard_rows, shard_bytes.

    size: Column of a row's bytes; null counts as 0. The limit holds for every shard, except that a single row of more
    bytes is a shard of its own page. Repeated rows (equal keys) have one hash: they share a shard while they fit and
    else fill pages 0, 1, ... of it. An empty table has no shards. Null keys are rows like any other.
    """
    store = Store(df.sparkSession)
    kept = [F.col(c) for c in (key, *keep)]
    slim = store.put(df.select(*kept, key_hash(F.col(key)).alias("h"), F.coalesce(size.cast("long"), F.lit(0)).alias("n_bytes")))
    by_hash = store.put(slim.groupBy("h").agg(F.count("*").alias("n_rows"), F.sum("n_bytes").alias("n_bytes")))
    total = by_hash.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    leaves = store.put(directory(by_hash, limit, total))
    store.drop(by_hash)
    # Row -> leaf: leaves down to the first histogram's level are listed as its cells, so that each row meets one cell.
    # Only rows below deeper leaves are looked up once for each deeper depth in use (at most 60 values).
    cut = first_level(total, limit)
    leaves = leaves.withColumnRenamed("n_rows", "shard_rows").withColumnRenamed("n_bytes", "shard_bytes")
    span = F.lit(cut) - F.col("depth")
    first = F.call_function("shiftleft", F.col("prefix"), span)
    cells = leaves.filter(F.col("depth") <= cut).withColumn("cell", F.explode(F.sequence(first, first + F.call_function("shiftleft", F.lit(1).cast("long"), span) - 1)))
    rows = slim.withColumn("cell", prefix(F.col("h"), F.lit(cut))).join(cells, "cell").drop("cell")
    deep = leaves.filter(F.col("depth") > cut)
    if depths := [r["depth"] for r in deep.select("depth").distinct().collect()]:
        below = deep.select(F.call_function("shiftright", F.col("prefix"), F.col("depth") - F.lit(cut)).alias("cell")).distinct()
        own = slim.withColumn("cell", prefix(F.col("h"), F.lit(cut))).join(below, "cell", "left_semi").drop("cell")
        own = own.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("prefix", prefix(F.col("h"), F.col("depth")))
        rows = rows.unionByName(own.join(deep, ["depth", "prefix"]))

    fits = rows.filter(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("long"))
    # Overflow chains. Rows of one hash and size are interchangeable: they are counted, laid out by prefix sums over
    # the sizes, and numbered within a size in salted groups, so that a hot key is never one window of all its rows.
    full = rows.filter(F.col("shard_bytes") > limit)
    largest = leaves.filter(F.col("shard_bytes") > limit).agg(F.max("shard_rows").alias("n")).first()["n"]
    if largest is not None:
        salt = F.pmod(F.hash(*[F.col(c) for c in (key, *keep)], F.monotonically_increasing_id()), F.lit(max(64, largest // SALT_ROWS)))
        full = store.put(full.withColumn("salt", salt))
        counts = store.put(full.groupBy("h", "n_bytes", "salt").agg(F.count("*").alias("n")))
        room = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))))
        sizes = counts.groupBy("h", "n_bytes").agg(F.sum("n").alias("n")).withColumn("pages", F.ceil(F.col("n") / room))
        sizes = sizes.withColumn("first_page", F.sum("pages").over(Window.partitionBy("h").orderBy("n_bytes").rowsBetween(Window.unboundedPreceding, -1)))
        before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("h", "n_bytes").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
        inner = F.row_number().over(Window.partitionBy("h", "n_bytes", "salt").orderBy(*[F.col(c) for c in (key, *keep)])) - 1
        full = full.withColumn("rank", inner).join(before, ["h", "n_bytes", "salt"]).join(sizes.select("h", "n_bytes", "first_page"), ["h", "n_bytes"])
        full = full.withColumn("page", (F.coalesce("first_page", F.lit(0)) + F.floor((F.col("rank") + F.coalesce("before", F.lit(0))) / room)).cast("long"))
        totals = full.groupBy("depth", "prefix", "page").agg(F.count("*").alias("shard_rows"), F.sum("n_bytes").alias("shard_bytes"))
        full = full.drop("shard_rows", "shard_bytes").join(totals, ["depth", "prefix", "page"])
        fits = fits.unionByName(full.select(fits.columns))
    return fits.select(*kept, "n_bytes", "depth", "prefix", "page", "shard_rows", "shard_bytes")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard, at the production limit."""
    docs = table(spark, sf_dir, "documents")
    return shard(docs, "doc_id", F.octet_length("text"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
lv AS (SELECT k::INTEGER AS depth, h >> (60 - k)::INTEGER AS prefix, count(*) AS shard_rows, sum(n_bytes)::BIGINT AS shard_bytes
       FROM d, range(0, 61) AS r(k) GROUP BY ALL),
leaf AS (SELECT lv.* FROM lv LEFT JOIN lv AS up ON up.depth = lv.depth - 1 AND up.prefix = lv.prefix >> 1
         WHERE lv.shard_bytes <= {SHARD_BYTES} AND (lv.depth = 0 OR up.shard_bytes > {SHARD_BYTES}))
SELECT d.doc_id, d.n_bytes, leaf.depth, leaf.prefix, 0::BIGINT AS page, leaf.shard_rows, leaf.shard_bytes
FROM d JOIN leaf ON d.h >> (60 - leaf.depth)::INTEGER = leaf.prefix
"""
