"""Connected components by alternating large and small stars, as joins and aggregations only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few_tasks

_EDGES = 500_000


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stars (node, smallest node reached) of some edges, by union-find over them alone."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    roots = np.array([root(x) for x in range(len(names))], np.int64)
    own = np.flatnonzero(roots != np.arange(len(names)))
    return names[own], names[roots[own]]


def _combined(edges: DataFrame) -> DataFrame:
    """Edges (u, v) -> fewer edges of the same components: each task turns its own, block by block, into stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars() -> pa.RecordBatch:
            u, v = local_stars(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= _EDGES:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()

    return edges.mapInArrow(run, "u long, v long")


def _settled(e: DataFrame, n: int) -> bool:
    """Whether the edges are stars already: every node has one smaller neighbour or is the smaller one, never both."""
    ends = e.select(F.col("u").alias("x"), F.col("v").alias("m")).union(e.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("m")))
    at = ends.groupBy("x").agg(F.min("m").alias("m0"), F.max("m").alias("m1"), F.bool_or(F.col("m").isNull()).alias("low"))
    return few_tasks(at.where("m0 is not null and (m0 <> m1 or low)"), n).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, component): the smallest node reachable. Nodes without an edge don't appear.

    Each task first combines its own edges. Then each half round is a map-side combined minimum and
    one join, until only stars are left; the number of rounds grows with the logarithm of the node
    count, whatever the diameter.
    """
    e = cut(_combined(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).distinct())
    n = e.count()
    e = few_tasks(e, n)  # stars never have more edges than the graph
    while not _settled(e, n):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = few_tasks(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), n)
        large = few_tasks(large.distinct(), n)
        joined = few_tasks(large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u"), n)
        e = joined.select("u", F.col("m").alias("v")).union(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = few_tasks(cut(few_tasks(_combined(e).distinct(), n)), n)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
