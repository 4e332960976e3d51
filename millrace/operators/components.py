"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize


def _fold(df: DataFrame) -> tuple:
    """An order-independent digest of an edge set, used to see when it no longer changes."""
    return tuple(
        df.agg(
            F.count(F.lit(1)),
            F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)),
            F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)),
        ).first()
    )


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node near it."""
    near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    return (
        near.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .distinct()
    )


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node with an edge; a component is named by its smallest node.

    Self-loops, repeated edges and null ends are ignored. Nodes without an edge do not appear. Work per
    round is a few shuffles of the edge table; sums are combined before the shuffle and no group is gathered.
    """
    a, b = F.col(src), F.col(dst)
    now = materialize(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = _fold(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        now = materialize(small_star(large_star(now)))
        was, seen = seen, _fold(now)
        if was == seen:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
