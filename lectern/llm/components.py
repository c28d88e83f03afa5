"""Connected components of an edge table: tasks contract their own links, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: Links that a task contracts; a task's memory is a few numbers for each.
OWN = 50_000


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step on edges (a > b): each node's larger (or smaller and own) neighbours move to the least node around it.

    The least neighbour is a partial aggregate and comes back by a join, so that a node with very many
    neighbours is split over tasks.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u").where(F.col("v") > F.col("u") if larger else F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger:
        moved = moved.unionByName(least.where("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.distinct()


def _mark(edges: DataFrame) -> tuple:
    h: Column = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h))).first())


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Columns a and b: each node of a task's own links, roots too, and the least node that it reaches over them."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                x, y = top(x), top(y)
                up[max(x, y)] = min(x, y)
            types = [b.schema.field(c).type for c in "ab"]
        nodes = list(up)
        for at in range(0, len(nodes), 10_000):
            some = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((some, map(top, some)), types, strict=True)], names=["a", "b"])

    return edges.coalesce(parts).mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """Columns ``a`` and ``b`` of ``links`` are nodes; returns (node, root), root the least node reachable.

    Only nodes with a link to another node come back. Repeated links, both directions and links to itself are
    fine; no links give no rows. Tasks contract their own links first; where one task has them all, that is the end. The
    number of steps then grows with the logarithm of the longest path, and each one's result is checkpointed.
    """
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parts = edges.count() // OWN + 1
    edges = _contracted(edges, parts)
    if parts == 1:
        return cut(edges.select(F.col("a").alias("node"), F.col("b").alias("root")))
    edges = cut(edges.where("a != b").distinct())
    mark = _mark(edges)
    while mark[0]:
        edges = cut(_star(_star(edges, True), False))
        if (now := _mark(edges)) == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
