"""Connected components of an edge table, by parent hooking and pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import Store


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node reachable. Self-links and repeats are allowed.

    Each round takes every node's smallest grandparent among its neighbours, hooks the node and its parent to it, and
    shortens paths; the number of rounds grows with the logarithm of the longest shortest path. Rounds are written to
    the shared folder, and a round's table is dropped once the next is written.
    """
    both = store.put(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = store.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("parent")))
    while True:
        parent = state.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        grand = store.put(state.join(parent, "parent").select("node", "parent", "grand"))
        near = both.join(grand.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("near"))
        known = grand.join(near, "node")
        proposals = known.select("node", F.least("parent", "grand", "near").alias("to")).union(known.select(F.col("parent").alias("node"), F.col("near").alias("to")))
        new = store.put(proposals.groupBy("node").agg(F.min("to").alias("parent")))
        moved = new.join(grand.select("node", F.col("parent").alias("old"), "grand"), "node").filter((F.col("parent") != F.col("old")) | (F.col("grand") != F.col("old")))
        done = moved.isEmpty()
        store.drop(state, grand)
        state = new
        if done:
            store.drop(both)
            return state.select("node", F.col("parent").alias("label"))
