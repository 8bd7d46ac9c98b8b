"""Connected components of an edge list: union-find inside each task, contraction across them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.llm.common import discard, written


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of the given edges."""
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    left, right = flat[: len(u)].tolist(), flat[len(u) :].tolist()
    parent = list(range(len(nodes)))
    for a, b in zip(left, right):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    for i in range(len(parent)):  # parents are smaller, so theirs are final already
        parent[i] = parent[parent[i]]
    return nodes, nodes[np.array(parent, dtype=np.int64)] if len(nodes) else nodes


def _forest(batches):
    """Edges -> a spanning star forest of each batch (at most one edge for each node of it)."""
    for batch in batches:
        u, v = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        nodes, root = union_find(u, v)
        keep = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long) -> (node long, component long), the smallest node reachable; only nodes with edges.

    Each task first reduces its edges to a forest by union-find, stars around their smallest nodes. Then, until no edge
    is left, every node joins its least neighbour (or itself) and the graph is contracted along these choices. Rounds
    take turns between the order of the nodes, which merges whole stars at once, and a fresh hashed order, which makes
    the expected number of rounds logarithmic whatever the shape. Every round is written to the shared folder. Hot
    nodes cost nothing: the minimum over neighbours is combined before the shuffle. Only whether edges are left reaches
    the driver.
    """
    left = written(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").mapInArrow(_forest, "u long, v long").distinct(), "cc-edges")
    start = left
    maps: list[DataFrame] = []
    rounds = 0
    while not left.isEmpty():
        least = F.min("v") if rounds % 2 == 0 else F.min(F.struct(F.xxhash64(F.col("v"), F.lit(rounds)).alias("p"), F.col("v")))["v"]
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.unionByName(left.select("u", F.col("u").alias("v"))).unionByName(left.select(F.col("v").alias("u"), "v"))
        to = written(both.groupBy("u").agg(least.alias("to")), "cc-map")
        a, b = to.toDF("u", "a"), to.toDF("v", "b")
        after = left.join(a, "u").join(b, "v").filter("a <> b")
        after = after.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).mapInArrow(_forest, "u long, v long").distinct()
        following = written(after, "cc-edges")
        if rounds:
            discard(left)
        left = following
        maps.append(to)
        rounds += 1
    if not maps:
        return start.select(F.col("u").alias("node"), F.col("v").alias("component"))
    root = maps[-1].toDF("node", "root")
    for to in reversed(maps[:-1]):  # only what a round merged needs the later rounds' choices
        root = to.toDF("node", "to").join(root.toDF("to", "root"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    root = written(root, "cc-root")
    smallest = written(root.groupBy("root").agg(F.min("node").alias("component")), "cc-least")
    return root.join(smallest, "root").select("node", "component")
