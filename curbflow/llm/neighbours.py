"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by the order of its nearest pivots and is posted in
the inverted file of its nearest one. A query opens the files of its own nearest pivots (a share of all, or what holds a
few times K vectors), ranks their members by the footrule distance between the two orders, taken over the query's
nearest pivots, and reranks the best of each block exactly; no other member's score is computed.

Equal vectors are indexed once, with their smallest ids: as ties go to the smaller id, no more than K + 1 of them can
ever be among K neighbours. Files are dealt to blocks of about one size: large ones are cut, small ones share a block. A
block is searched by one task for all queries that open it. Vectors of another length have pivots, files and blocks of
their own. A vector is known by its smallest id and a hash, as one id can have several vectors.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import Store, prepare, table

K = 20
#: Pivots of a length; the query's nearest pivots that the footrule is taken over; share of all files that a query opens.
PIVOTS, PREFIX, OPEN = 256, 96, 0.75
#: What is reranked of a block: a share of its opened members, and so many for each neighbour that is wanted.
RERANK, MARGIN = 0.15, 4
#: Distinct vectors of a block, about.
BLOCK = 8192
#: Members whose footrule distances are summed at a time.
CHUNK = 2048
QUERY_EVERY = 20


def usable(vec: str = "embedding"):
    """Vectors that take part: not null, not empty or zero, all components finite."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


class Pivots:
    """The pivots of one length. Their files are numbered from `first` on."""

    def __init__(self, vectors: np.ndarray, first: int):
        self.vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.first = first
        self.sizes = np.zeros(len(vectors), dtype=np.int64)  # of the files, once they are known

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector its pivots, nearest first."""
        return np.argsort(-(vectors @ self.vectors.T), axis=1, kind="stable")

    def places(self, order: np.ndarray) -> np.ndarray:
        """For each vector the place of every pivot in its order; pivots are rows."""
        at = np.empty(order.shape, dtype=np.int16)
        np.put_along_axis(at, order, np.arange(order.shape[1], dtype=at.dtype)[None, :], axis=1)
        return np.ascontiguousarray(at.T)

    def opens(self, order: np.ndarray, share: float, least: int) -> np.ndarray:
        """Which files each query opens: that share of them, or as many as hold the least number of vectors."""
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        taken = (np.arange(order.shape[1]) < share * order.shape[1]) | (before < least)
        out = np.empty_like(taken)
        np.put_along_axis(out, order, taken, axis=1)
        return out


def plan_blocks(sizes: dict[int, int], block: int, start: int = 0) -> dict[int, list[int]]:
    """File -> its blocks, numbered from start on, of about one size: large files are cut, each other one goes to the emptiest block."""
    total = sum(sizes.values())
    most = -(-total // -(-total // block)) if total else 0
    plan = {}
    for file, n in sorted(sizes.items()):
        if n > most:
            plan[file] = list(range(start, start + -(-n // most)))
            start += len(plan[file])
    small = sorted((f for f in sizes if f not in plan), key=lambda f: (-sizes[f], f))
    bins = [(0, start + i) for i in range(-(-sum(sizes[f] for f in small) // most))] if small else []
    for file in small:
        filled, number = heapq.heappop(bins)
        plan[file] = [number]
        heapq.heappush(bins, (filled + sizes[file], number))
    return plan


def chunked(places: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(places[:, at : at + CHUNK]) for at in range(0, places.shape[1], CHUNK)]


def footrule(places: list[np.ndarray], near: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Each member's footrule distance over these pivots, whose places for the query are 0, 1, 2 ...

    Members come in chunks, in room that is used again: that stays in the processor's cache.
    """
    own, at = np.arange(len(near), dtype=np.int16)[:, None], 0
    apart = np.empty(sum(p.shape[1] for p in places), dtype=np.int16 if len(near) * len(places[0]) < 1 << 15 else np.int32)
    for part in places:
        n = part.shape[1]
        theirs = room[: len(near) * n].reshape(len(near), n)
        np.take(part, near, axis=0, out=theirs, mode="clip")
        np.subtract(theirs, own, out=theirs)
        np.abs(theirs, out=theirs)
        theirs.sum(axis=0, dtype=apart.dtype, out=apart[at : at + n])
        at += n
    return apart


def searcher(indexes: dict[int, Pivots], open_share: float, prefix: int, rerank: float, k: int):
    schema = pa.schema([("query", pa.int64()), ("query_tag", pa.int64()), ("rep", pa.int64()), ("tag", pa.int64()), ("score", pa.float64())])

    def search(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            return schema.empty_table()
        vectors, own = matrix(members["embedding"]), matrix(queries["embedding"])
        pivots = indexes[vectors.shape[1]]
        ids, tags, files = (members[c].to_numpy() for c in ("rep", "tag", "file"))
        files = files - pivots.first
        places, order = chunked(pivots.places(pivots.order(vectors))), pivots.order(own)
        opens, found = pivots.opens(order, open_share, MARGIN * k), []
        room, picked = np.empty(min(prefix, order.shape[1]) * min(CHUNK, len(vectors)), dtype=np.int16), np.empty_like(vectors)
        for i, q in enumerate(own):
            seen = opens[i][files]
            n = int(np.count_nonzero(seen))
            if not n:
                continue
            keep = int(np.ceil(rerank * n)) + MARGIN * k
            if keep < n:
                apart = footrule(places, order[i, :prefix], room)
                apart[~seen] = np.iinfo(apart.dtype).max
                at = np.argpartition(apart, keep - 1)[:keep]
            else:
                at = np.flatnonzero(seen)
            score = np.take(vectors, at, axis=0, out=picked[: len(at)], mode="clip") @ q
            if len(at) > k + 1:
                # k + 1 ids, and all ties of the last place, so that the smaller id can win
                good = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                if len(np.unique(ids[at[good]])) <= k:  # ids with several vectors
                    best = np.argsort(-score, kind="stable")
                    first = np.sort(np.unique(ids[at[best]], return_index=True)[1])
                    good = score >= score[best[first[min(k, len(first) - 1)]]]
                    if len(first) <= k:
                        good[:] = True
                at, score = at[good], score[good]
            found.append((i, at, score))
        if not found:
            return schema.empty_table()
        who = np.repeat([i for i, _, _ in found], [len(at) for _, at, _ in found])
        at, score = (np.concatenate([x[c] for x in found]) for c in (1, 2))
        return pa.table([queries["rep"].to_numpy()[who], queries["tag"].to_numpy()[who], ids[at], tags[at], score], schema=schema)

    return search


def by_length(batch: pa.RecordBatch):
    """Parts of a batch whose vectors have one length."""
    sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield int(size), batch.take(pa.array(np.flatnonzero(sizes == size)))


def neighbours(vectors: DataFrame, queries, k: int = K, pivots: int = PIVOTS, open_share: float = OPEN, rerank: float = RERANK, block: int = BLOCK, prefix: int = PREFIX) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of vectors (vec_id, embedding) by inner product.

    queries: Column that is true for the rows to search for; candidates are all rows but the query's own (rows of its
    vec_id). Ties go to the smaller vec_id; fewer candidates give fewer rows. Vectors that are null, zero or hold null or
    non-finite components, and rows without vec_id, take no part. Vectors are searched among those of their length; up to
    `pivots` of each length are held by the driver. Repeated rows of one id count once; an id with several vectors is as
    near as the nearest of them, as a query and as a candidate. An empty table gives no rows. Other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    store = Store(spark)
    kind = vectors.schema["embedding"].dataType.simpleString()
    valid = store.put(vectors.filter(F.col("vec_id").isNotNull() & usable()).withColumn("asked", queries).select("vec_id", "embedding", "asked"))
    # The K + 1 smallest ids of every distinct vector; hot vectors are cut before the shuffle by the group limit.
    smallest = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = valid.groupBy("embedding", "vec_id").agg(F.max("asked").alias("asked")).withColumn("n", smallest).filter(F.col("n") <= k + 1)
    distinct = few.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = store.put(distinct.select("rep", F.xxhash64("embedding").alias("tag"), "embedding", "ids"))
    picked = Window.partitionBy(F.size("embedding")).orderBy(F.xxhash64("rep", "tag"), "rep", "tag")
    chosen = distinct.select("embedding", F.size("embedding").alias("size"), F.row_number().over(picked).alias("n")).filter(F.col("n") <= pivots).orderBy("size", "n").collect()
    indexes: dict[int, Pivots] = {}
    for size in sorted({r["size"] for r in chosen}):
        first = sum(len(x.vectors) for x in indexes.values())
        indexes[size] = Pivots(np.array([r["embedding"] for r in chosen if r["size"] == size], dtype=np.float64), first)
    if not indexes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def post(batches):
        for batch in batches:
            for size, part in by_length(batch):
                nearest = indexes[size].first + indexes[size].order(matrix(part.column("embedding")))[:, 0]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nearest)], ["rep", "tag", "embedding", "file"])

    posted = store.put(distinct.select("rep", "tag", "embedding").mapInArrow(post, f"rep long, tag long, embedding {kind}, file long"))
    sizes = {r["file"]: r["count"] for r in posted.groupBy("file").count().collect()}
    plan: dict[int, list[int]] = {}
    for index in indexes.values():
        own = {f: sizes[f] for f in range(index.first, index.first + len(index.vectors)) if f in sizes}
        index.sizes[[f - index.first for f in own]] = list(own.values())
        plan |= plan_blocks(own, block, 1 + max((b for bs in plan.values() for b in bs), default=-1))
    parts = F.element_at(F.array(*[F.array(*map(F.lit, plan.get(f, [-1]))) for f in range(len(chosen))]), (F.col("file") + 1).cast("int"))
    members = posted.withColumn("block", F.element_at(parts, (F.pmod(F.xxhash64("rep", "tag"), F.size(parts)) + 1).cast("int")))

    asked = store.put(valid.filter("asked").select("vec_id", "embedding").distinct().join(distinct.select("embedding", "rep", "tag"), "embedding").select("vec_id", F.col("rep").alias("query"), F.col("tag").alias("query_tag")))
    store.drop(valid)
    wanted = posted.select("rep", "tag", "embedding").join(asked.select(F.col("query").alias("rep"), F.col("query_tag").alias("tag")).distinct(), ["rep", "tag"], "left_semi")

    def open_files(batches):
        for batch in batches:
            for size, own in by_length(batch):
                index = indexes[size]
                opens = index.opens(index.order(matrix(own.column("embedding"))), open_share, MARGIN * k)
                to = [sorted({b for f in np.flatnonzero(row).tolist() for b in plan.get(index.first + f, ())}) for row in opens]
                part = own.take(pa.array(np.repeat(np.arange(len(to)), [len(x) for x in to])))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([b for x in to for b in x], pa.int32())], ["rep", "tag", "embedding", "block"])

    searches = wanted.select("rep", "tag", "embedding").mapInArrow(open_files, f"rep long, tag long, embedding {kind}, block int")
    search = searcher(indexes, open_share, prefix, rerank, k)
    found = members.groupBy("block").cogroup(searches.groupBy("block")).applyInArrow(search, "query long, query_tag long, rep long, tag long, score double")
    # The vectors of k + 1 different smallest ids, then k + 1 different ids, which leaves k besides the query's own.
    asker = Window.partitionBy("query", "query_tag")
    new = F.row_number().over(Window.partitionBy("query", "query_tag", "rep").orderBy(F.desc("score"), "tag")) == 1
    so_far = F.sum(F.col("new").cast("int")).over(asker.orderBy(F.desc("score"), "rep", "tag").rowsBetween(Window.unboundedPreceding, 0))
    top = found.withColumn("new", new).withColumn("so_far", so_far).filter(F.col("so_far") <= k + 1).select("query", "query_tag", "rep", "tag", "score")
    ids = top.join(distinct.select("rep", "tag", "ids"), ["rep", "tag"]).select("query", "query_tag", "score", F.explode("ids").alias("vec_id")).repartition("query", "query_tag")
    ids = ids.groupBy("query", "query_tag", "vec_id").agg(F.max("score").alias("score"))
    ids = ids.withColumn("place", F.row_number().over(asker.orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= k + 1).drop("place")
    pairs = asked.withColumnRenamed("vec_id", "query_id").join(ids, ["query", "query_tag"]).filter(F.col("vec_id") != F.col("query_id"))
    pairs = pairs.select("query_id", "vec_id", "score").repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return pairs.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= k)


def op9_neighbours(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
