"""Connected components by alternating large-star and small-star steps.

Each step keeps at most as many edges as it was given; a node's smallest
neighbour comes from a map-side-combined ``min`` and is joined back to the
edges, so a hub with a third of all edges costs a skewed equi-join (which AQE
splits) and never a group in one task.  Every step is written below the
shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import cut, few


def _to_min(edges: DataFrame) -> DataFrame:
    """Edges ``(x, y)`` with the least of x and its neighbours as ``m``."""
    low = edges.groupBy("x").agg(F.min("y").alias("m"))
    return edges.join(low.select("x", F.least("x", "m").alias("m")), "x")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    return (_to_min(both).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
            .distinct())


def _small(edges: DataFrame) -> DataFrame:
    near = _to_min(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")))
    return (near.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
            .union(near.select("x", F.col("m").alias("y"))).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to the least of its component: no node
    is both ends of edges, and none the upper end of two."""
    ends = (edges.select(F.col("x").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("low"))
            .union(edges.select("y", F.lit(0), F.lit(1))))
    odd = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or (up = 1 and low = 1)")
    return odd.isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of an edge that has another end:
    ``component`` is the least node reachable.  Edges with a NULL end, loops
    and repeated edges change nothing; no edges give no rows."""
    cur = cut(few(edges.where(f"{a} <> {b}")
                  .select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct()), "edges")
    while not _stars(cur):
        cur = cut(few(_small(_large(cur))), "stars")
    return (cur.select(F.col("x").alias("node"), F.col("y").alias("component"))
            .union(cur.select("y", "y")).distinct())


def merged(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges ``(a, b)`` that connect what ``edges`` connect, after one step
    towards stars: for use between rounds that add edges."""
    cur = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    return cut(few(_small(_large(cur))), "stars").select(F.col("x").alias(a), F.col("y").alias(b))


def labels(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of the edges of ``merged``, settled
    or not: nodes with one label are connected, connected nodes may still have
    different ones; hubs need one step or two."""
    return (edges.select(F.col(a).alias("node"), F.col(b).alias("component")).union(edges.select(b, b))
            .groupBy("node").agg(F.min("component").alias("component")))
