"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def spanning_stars(a, b):
    """Root and member arrays of a spanning forest of the edges (a, b); the root is the smallest node."""
    import numpy as np

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
    pairs = [(find(x), x) for x in parent if parent[x] != x]
    out = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


#: Edges that a task contracts at once.
CONTRACTED = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges -> a spanning forest of stars of each ``CONTRACTED`` of them."""
    import numpy as np

    held: list = []
    size = 0

    def stars() -> pa.RecordBatch:
        root, member = spanning_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(root), pa.array(member)], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= CONTRACTED:
                yield stars()
                held, size = [], 0
    if held:
        yield stars()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node, component)``, the component being its smallest node.

    Each round is two aggregations with map-side combination and two joins; hub nodes are split by the
    adaptive skew join. Edges contract inside tasks first, then again in as few tasks as hold what is left, so
    long chains shorten before the first shuffle. Rounds are written to the shared folder, so lineage stays
    one round deep. Nodes without an edge are absent; self loops and repeated edges are harmless.
    """
    plain = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = materialize(plain.mapInArrow(_contract, "a long, b long").distinct(), "cc")
    few = max(1, -(-edges.count() // CONTRACTED))
    edges = materialize(edges.coalesce(few).mapInArrow(_contract, "a long, b long").distinct(), "cc")
    mark = _mark(edges)
    if mark[0] == 0:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # every large edge is (smaller, larger): the small star hangs b's smaller neighbours on the least of them
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(small, "b")
        edges = materialize(moved.select(F.col("m").alias("a"), F.col("b")).unionByName(moved.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct(), "cc")
        now = _mark(edges)
        if now == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
