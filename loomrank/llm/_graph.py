"""Connected components by distributed union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import drop_written, trimmed, written

#: Edges of a partition; they bound the memory of a task.
EDGES = 500_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node of the edges (a, b)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        # hook the larger root of every open edge to the smallest one that meets it, then halve all paths
        ra, rb = parent[left], parent[right]
        open_ = ra != rb
        if not open_.any():
            return nodes, nodes[parent]
        left, right, ra, rb = left[open_], right[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _local(batches):
    """One partition's edges to (node, root) rows: a spanning forest of stars."""
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        if sum(map(len, a)) > 4_000_000:
            node, root = union_find(np.concatenate(a), np.concatenate(b))
            a, b = [node], [root]
    if a and sum(map(len, a)):
        node, root = union_find(np.concatenate(a), np.concatenate(b))
        for i in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 100_000]), pa.array(root[i : i + 100_000])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns); root is the component's smallest node.

    Edges are held in partitions of about ``EDGES``. Every round contracts each partition by union-find and
    then hooks the roots that different partitions gave to one node; with one partition the first round is
    the last. A node has one row a partition at most, so a hub with any number of edges is never gathered;
    no edge or label reaches the driver.
    """
    parts = edges.count() // EDGES + 1
    found = edges.toDF("a", "b").coalesce(parts).mapInArrow(trimmed(_local), "node long, root long")
    if parts == 1:
        return found
    before = None
    while True:
        least = F.min("root").over(Window.partitionBy("node"))
        state = written(found.withColumn("least", least), "components")
        if before is not None:
            drop_written(before)
        if not state.where("root <> least").limit(1).count():
            return state.select("node", F.col("least").alias("root")).distinct()
        hooks = state.where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b"))
        found = state.select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(hooks).distinct().coalesce(parts).mapInArrow(trimmed(_local), "node long, root long")
        before = state
