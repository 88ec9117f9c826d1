"""Connected components of an edge table, without bringing edges or components to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Edges that one task solves in memory (two longs each); beyond, rounds over the whole table contract them.
IN_ONE_TASK = 1_000_000


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, root) of all edges (a, b): every root is hooked to its smallest neighbour and trees are flattened, until no
    edge joins two trees."""
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if not parts:
        return
    names, at = np.unique(np.concatenate([x for side in (0, 1) for x in (p[side] for p in parts)]), return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(names))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (upper := root[root]).tobytes() != root.tobytes():
            root = upper
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    for low in range(0, len(names), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(names[low : low + 100_000]), pa.array(names[root[low : low + 100_000]])], ["v", "p"])


def _flatten(parents: DataFrame) -> DataFrame:
    """Follow parents (v, p) to the roots by pointer doubling."""
    while True:
        upper = parents.select(F.col("v").alias("uv"), F.col("p").alias("up"))
        jumped = common.cut(parents.join(upper, F.col("p") == F.col("uv"), "left").select("v", F.coalesce("up", "p").alias("q"), "p"))
        parents = jumped.select("v", F.col("q").alias("p"))
        if jumped.where("q <> p").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b); root is the smallest vertex of its component.

    Up to IN_ONE_TASK edges (their number is checked) are solved by one task. Above that, each round hooks every vertex to
    its smallest neighbour, flattens the trees and contracts the edges, so the rounds grow with the logarithm of the
    vertices; every join reads two plain exchanges, which the engine splits where one vertex has very many edges.
    """
    left = common.cut(edges.where("a <> b").select("a", "b").distinct())
    known = None
    while n := left.count():
        common.release(edges.sparkSession)
        if n <= IN_ONE_TASK:
            roots = common.cut(left.coalesce(1).mapInArrow(_solve, "v long, p long"))
        else:
            both = left.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(left.select(F.col("b").alias("v"), F.col("a").alias("w")))
            roots = _flatten(common.cut(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("p"))))
        if known is None:
            known = roots
        else:
            upper = roots.select(F.col("v").alias("uv"), F.col("p").alias("up"))
            known = common.cut(known.join(upper, F.col("p") == F.col("uv"), "left").select("v", F.coalesce("up", "p").alias("p")))
        if n <= IN_ONE_TASK:
            break
        ra, rb = roots.select(F.col("v").alias("a"), F.col("p").alias("pa")), roots.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        left = common.cut(left.join(ra, "a").join(rb, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    if known is None:
        return left.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return known.select("v", F.col("p").alias("root"))
