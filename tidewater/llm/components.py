"""Connected components of an edge table by union-find: first within each partition, then by stars across partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shingles import mix
from tidewater.workspace import compacted, materialize

EDGE = "u long, v long"


class UnionFind:
    """Disjoint sets whose root is their smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = up
        return root

    def union(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        self.parent.setdefault(a, a)
        self.parent.setdefault(b, b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


NODES = 250_000  # of a forest that a task holds


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition to one edge per node, to the node's root there; emptied now and then to bound memory."""
    sets = UnionFind()

    def edges():
        rows = [(x, r) for x in sets.parent if (r := sets.find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(u, v)
        if len(sets.parent) > NODES:
            yield edges()
            sets = UnionFind()
    yield edges()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition and an order-independent sum over them."""
    rows = total = 0
    for batch in batches:
        u, v = (batch.column(k).to_numpy().astype(np.uint64) for k in (0, 1))
        rows += len(u)
        total = (total + int(mix(mix(u) + v).sum(dtype=np.uint64))) % 2**64
    yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([total - 2**63])], ["rows", "total"])


ROWS = 100_000  # of a partition, at most about
BROADCAST = 200_000  # edges, so nodes at most twice that, of a table that is broadcast


def _with(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """Edges with their node's least neighbour: a broadcast where the edges were counted to be few, else a join that
    adaptive execution may split at hubs."""
    return edges.join(F.broadcast(least) if rows <= BROADCAST else least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v) that isn't its own root: root is the smallest node reachable.

    Partition-wise union-find leaves one edge per node and partition. Alternating large and small stars then reroot every
    node at its smallest neighbour until nothing changes: a logarithmic number of rounds, each stored in the shared folder;
    of every round the driver sees two numbers per partition. Neighbours are combined before they are shuffled, and no
    node's edges are gathered in one task.
    """
    now, rows = compacted(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(_forest, EDGE), ROWS)
    if not rows:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = _with(both.where("v > u"), least, rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _with(down, lowest, rows).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lowest.select("u", F.col("m").alias("v")))
        now = materialize(small.mapInArrow(_forest, EDGE))
        parts = now.mapInArrow(_digest, "rows long, total long").collect()
        rows = sum(p.rows for p in parts)
        now = now.coalesce(max(1, -(-rows // ROWS)))
        state = (rows, sum(p.total + 2**63 for p in parts) % 2**64)
        if state == seen:
            return compacted(now.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct())[0]
        seen = state
