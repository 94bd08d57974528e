"""Connected components over an edge table, by joins and aggregates alone.

Alternating large-star and small-star rounds (Kiveris et al., 2014): every round hangs
nodes onto smaller neighbours, until the edge set is a set of stars, after a number of
rounds that grows with the logarithm of the size. A hub of any size is safe: neighbour
minima are partial aggregates, and each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours onto the smallest of the node and its neighbours."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = written(least, "cc-least")
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours onto the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(kept).where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Does every node hang on at most one other, and nothing hang on a node that hangs?"""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    held = roles.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return held.where("down > 1 OR (down > 0 AND up > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges(a, b)``; the component is its smallest
    node. Loops and repeated edges do no harm; rows with a null end are left out."""
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "cc-edges",
    )
    while not _are_stars(now):
        now = written(_small_star(_large_star(now)), "cc-edges")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)
