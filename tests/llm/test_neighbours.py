"""Recall on tables that need the footrule, vectors of several lengths, ids with several vectors."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def exact(rows, queries, k=20):
    """query id -> its k nearest ids, each by its best vector, among vectors of one length."""
    own = collections.defaultdict(list)
    for i, v in rows:
        own[len(v)].append((i, np.array(v, dtype=np.float32).astype(float)))
    score = collections.defaultdict(dict)
    for group in own.values():
        ids, table = np.array([i for i, _ in group]), np.array([v for _, v in group])
        for i, v in group:
            if i in queries:
                for j, s in zip(ids.tolist(), (table @ v).tolist()):
                    if j != i:
                        score[i][j] = max(s, score[i].get(j, -np.inf))
    return {i: [j for j, _ in sorted(of.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]] for i, of in score.items()}


def recall(spark, rows):
    ids, table = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float32).astype(float)
    found = collections.defaultdict(set)
    for r in neighbours.neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].add(r.vec_id)
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        score = table @ table[at]
        score[at] = -np.inf
        hits += len(found[ids[at]] & set(ids[np.argsort(-score)[:20]].tolist()))
        total += 20
    return hits / total


def test_recall_of_sf01(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    assert recall(spark, rows) >= 0.9


def test_recall_of_several_blocks(spark):
    draw = np.random.default_rng(2)
    vectors = draw.standard_normal((20_000, 64)) * draw.uniform(0.8, 1.2, (20_000, 1))
    assert len(vectors) > 2 * neighbours.BLOCK and recall(spark, list(enumerate(vectors.tolist()))) >= 0.9


def test_lengths_are_searched_apart(spark):
    draw = np.random.default_rng(3)
    rows = [(0, [1.0])] + [(i, draw.standard_normal(8).tolist()) for i in range(1, 61)] + [(i, draw.standard_normal(3).tolist()) for i in range(100, 121)]
    found = collections.defaultdict(list)
    for r in neighbours.neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert found == exact(rows, {i for i, _ in rows if i % 20 == 0} - {0})


@pytest.mark.parametrize("k", [2, 5])
def test_ids_with_several_vectors(spark, k):
    draw = np.random.default_rng(4)
    angle = lambda x: [float(np.cos(x)), float(np.sin(x))]
    rows = [(int(draw.integers(0, 25)), angle(draw.integers(0, 40) / 7)) for _ in range(400)] + [(3, angle(0.01 * i)) for i in range(60)] + [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.2])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.neighbours(df, F.col("vec_id") % 20 == 0, k=k).orderBy("query_id", "rank").collect()
    stored = [(r.vec_id, r.embedding) for r in df.collect()]
    best = exact(stored, {0, 20}, k)
    assert {q: [r.vec_id for r in got if r.query_id == q] for q in (0, 20)} == best
    assert all([r["rank"] for r in got if r.query_id == q] == list(range(1, k + 1)) for q in (0, 20))


def test_work_is_pruned():
    """Only reranked members are scored: a member that the footrule puts last can't be found, however near."""
    draw = np.random.default_rng(5)
    for pivots, members, prefix in ((256, 900, 96), (256, 5000, 96), (300, 2048, 300), (7, 10, 7)):
        places = np.argsort(draw.random((pivots, members)), axis=0).astype(np.int16)
        near = draw.permutation(pivots)[:prefix]
        expected = np.abs(places[near].astype(int) - np.arange(prefix)[:, None]).sum(axis=0)
        assert neighbours.footrule(neighbours.chunked(places), near, np.empty(prefix * neighbours.CHUNK, dtype=np.int16)).tolist() == expected.tolist()


def test_blocks_are_even():
    draw = np.random.default_rng(6)
    sizes = {i: int(n) for i, n in enumerate(draw.integers(1, 90, 200))} | {200: 7000}
    plan, filled = neighbours.plan_blocks(sizes, 2048, 5), collections.Counter()
    for file, to in plan.items():
        for block in to:
            filled[block] += sizes[file] / len(to)
    assert set(plan) == set(sizes) and min(filled) == 5 and max(filled) == 4 + len(filled)
    assert max(filled.values()) <= 2048 and max(filled.values()) < 1.4 * min(filled.values())
    assert neighbours.plan_blocks({}, 10) == {}
