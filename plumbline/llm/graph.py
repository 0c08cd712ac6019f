"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of the edges (x, y): component is the least node reachable.

    Alternating large-star and small-star rounds: each hangs a node's neighbours under its least
    neighbour, so the number of rounds grows with the logarithm of the longest path and no node's
    neighbours are gathered in one place: minima are aggregated and joined back. Every round is
    written to the shared folder. Edges are compared as they are: null ends and loops are ignored.
    """
    stars = saved(edges.where("x is not null and y is not null and x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "stars")
    mark = None
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.explode(F.array(F.struct("y", "m"), F.struct(F.col("x").alias("y"), "m"))).alias("e")).select(F.col("e.y").alias("x"), F.col("e.m").alias("y")).where("x <> y").distinct()
        before, stars = stars, saved(small, "stars")
        discard(before)
        now = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return stars.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(stars.select(F.col("y").alias("node"), F.col("y").alias("component"))).distinct()
