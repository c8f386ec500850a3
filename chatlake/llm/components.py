"""Connected components of an edge table: contracted within tasks, then by alternating large and small stars; nothing but counts reaches
the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.session import discard, materialise

#: Edges of one task of the contraction; a table of no more is solved by it.
TASK_EDGES = 1 << 20


def contracted(edges: DataFrame) -> DataFrame:
    """``u`` and ``v`` (v < u): every node of a task's edges with the smallest node that it reaches by them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack((b["u"].to_numpy(), b["v"].to_numpy())) for b in batches]
        both = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
        nodes, ends = np.unique(both, return_inverse=True)
        parent = list(range(len(nodes)))
        for a, b in zip(*ends.reshape(2, -1).tolist(), strict=True):
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            # Nodes are in order, so the smaller number is the smaller node.
            if a < b:
                parent[b] = a
            else:
                parent[a] = b
        root = np.array(parent, np.int64)
        while len(root) and (root[root] != root).any():
            root = root[root]
        below = root != np.arange(len(root))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[root[below]])], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int = TASK_EDGES) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node that has an edge to another; written. ``edges`` is stored."""
    plain = edges.filter(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    tasks = max(1, -(-plain.count() // task_edges))
    pairs, seen = materialise(contracted(plain.coalesce(tasks)), "star"), None
    while tasks > 1:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, pairs = pairs, materialise(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "star")
        discard(old)
        state = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    found = materialise(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
    discard(pairs)
    return found
