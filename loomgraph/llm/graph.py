"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


LOCAL_EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is the least node of its component.

    Each round is two joins with per-node minima, and the edge count never grows; a chain of n nodes takes about log n rounds.
    The state is written to the checkpoint folder each round. Nothing but two numbers comes to the driver.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(e)
    while before[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x"))
        e = cut(small.select("x.a", "x.b").where("a <> b").distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _local(pairs: pa.Table) -> pa.Table:
    """(node, root) of a small edge table."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
        up.setdefault(a, a)
        up.setdefault(b, b)
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return pa.table({"node": pa.array(list(up), pa.int64()), "root": pa.array([top(x) for x in up], pa.int64())})


def grown(roots: DataFrame | None, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``roots`` (node, root), as ``components`` gives them, after more ``edges``; none before the first ones.

    Only edges between components count. Up to ``local_edges`` of them, which is counted, are joined on the driver; more go by rounds.
    """
    spark = edges.sparkSession
    if roots is not None:
        of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias("root_" + x))
        edges = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n = e.count()
    if not n and roots is not None:
        return roots
    moved = spark.createDataFrame(_local(e.toArrow())) if n <= local_edges else components(e)
    if roots is None:
        return cut(moved)
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("new"))
    old = roots.join(to, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return cut(old.union(moved.join(roots, "node", "left_anti").select("node", "root")))
