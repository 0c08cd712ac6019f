"""Wall lines and the gaps between them, for every capture at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import histograms as H
from ..operators import joins as J
from ..operators import sequences as S
from ..operators.grids import cut
from .levels import KERNEL

SIDE = ("capture", "axis", "sign")


def facing(points: DataFrame, least: int = 50, cosine: float = 0.85) -> DataFrame:
    """(capture, axis, sign, c, t) of wall points (capture, x, z, nx, nz): the coordinate across and along each of the four facing directions that has `least` points or more."""
    sides = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("sign")) for a in (0, 1) for s in (1, -1)])
    rows = points.withColumn("_s", F.explode(sides)).select("capture", "_s.axis", "_s.sign", "x", "z", "nx", "nz")
    across = F.col("axis") == 0
    rows = rows.where(F.when(across, F.col("nx")).otherwise(F.col("nz")) * F.col("sign") > cosine)
    rows = rows.select(*SIDE, F.when(across, F.col("x")).otherwise(F.col("z")).alias("c"), F.when(across, F.col("z")).otherwise(F.col("x")).alias("t"))
    enough = rows.groupBy(*SIDE).agg(F.count(F.lit(1)).alias("_n"), (F.min("c") - 0.05).alias("lo")).where(F.col("_n") >= least).drop("_n")
    return rows.join(enough, list(SIDE))


def wall_lines(points: DataFrame, bin_size: float = 0.01, window: float = 0.035, apart: float = 0.06, strong: float = 15.0, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Lines (capture, axis, sign, line, c, sd, n) and their occupied segments (capture, axis, sign, line, a, b).

    Peaks of the coordinate across a direction, the strongest first with none within `apart` of one
    taken; a peak with fewer than `least` points near it still keeps others away. Lines are refitted
    robustly, and only those with a segment stay.
    """
    rows = cut(facing(points).withColumn("d", F.col("c") - F.col("lo")))
    smoothed = H.smooth(H.dense_histogram(rows.select(*SIDE, "d"), "d", bin_size, keys=SIDE, anchor=0.0, pad=4), KERNEL, keys=SIDE)
    found = H.suppress(H.peaks(smoothed, bin_size, F.lit(strong - 1e-9), keys=SIDE), SIDE, apart)
    lows = rows.select(*SIDE, "lo").distinct()
    found = cut(found.join(lows, list(SIDE)).select(*SIDE, F.col("bin").alias("line"), (F.col("level") + F.col("lo")).alias("guess")))
    near = J.near_join(rows.select(*SIDE, "c", "t"), found, "c", "guess", window, SIDE).where(F.abs(F.col("c") - F.col("guess")) < window)
    keys = (*SIDE, "line")
    enough = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    near = cut(near.join(enough, list(keys), "left_semi"))
    level = H.robust_level(near, "c", "guess", window, keys=keys).withColumnRenamed("level", "c")
    parts = cut(S.segments(near.select(*keys, "t"), "t", keys, res=0.02).drop("length"))
    return cut(level.join(parts.select(*keys).distinct(), list(keys), "left_semi")), parts


def wall_gaps(lines: DataFrame, parts: DataFrame, narrow: float = 0.45, wide: float = 4.5, together: float = 0.12, reach: float = 0.25) -> DataFrame:
    """(capture, axis, sign, cluster, host, c, a, b): openings along collinear lines, from a segment's end to the next start or crossing wall, that no segment covers."""
    chained = S.chain_clusters(lines, "c", "line", SIDE, together)
    keys = (*SIDE, "cluster")
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), "c")
    hosts = chained.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*keys, F.col("line").alias("host"), F.col("c").alias("host_c"))
    clusters = chained.groupBy(*keys).agg(F.percentile("c", 0.5).alias("c")).join(hosts, list(keys))
    solid = parts.join(chained.select(*SIDE, "line", "cluster"), [*SIDE, "line"]).select(*keys, "a", "b")

    # walls across that reach the cluster's line: their own coordinate is a stop
    cell = 1.0
    across = parts.join(lines.select(*SIDE, "line", "c"), [*SIDE, "line"]).select("capture", (1 - F.col("axis")).alias("axis"), F.col("c").alias("stop"), (F.col("a") - reach).alias("from"), (F.col("b") + reach).alias("to"))
    across = across.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("from") / cell), F.floor(F.col("to") / cell))))
    met = clusters.select(*keys, "c", F.floor(F.col("c") / cell).alias("_cell")).join(across, ["capture", "axis", "_cell"]).where((F.col("from") <= F.col("c")) & (F.col("c") <= F.col("to")))
    crossings = met.select(*keys, "stop").distinct()

    starts, ends = solid.select(*keys, F.col("a").alias("stop")), solid.select(*keys, F.col("b").alias("stop"))
    forward = J.next_stop(solid.select(*keys, "b").distinct(), starts.unionByName(crossings).distinct(), "b", "stop", keys, 0.02).select(*keys, F.col("b").alias("a"), F.col("next").alias("b"))
    turned = ends.unionByName(crossings).select(*keys, (-F.col("stop")).alias("stop")).distinct()
    backward = J.next_stop(solid.select(*keys, (-F.col("a")).alias("m")).distinct(), turned, "m", "stop", keys, 0.02).select(*keys, (-F.col("next")).alias("a"), (-F.col("m")).alias("b"))
    both = forward.unionByName(backward).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("b") - F.col("a")).between(narrow, wide))
    both = both.groupBy(*keys, F.bround("a", 2).alias("_a"), F.bround("b", 2).alias("_b")).agg(F.min_by("a", "a").alias("a"), F.min_by("b", "a").alias("b"))
    free = J.not_covered(both, solid.select(*keys, F.col("a").alias("_s"), F.col("b").alias("_e")), ("a", "b"), ("_s", "_e"), [*keys, "_a", "_b"], cell, keys)
    return free.join(clusters, list(keys)).select(*keys, "host", F.col("host_c").alias("c"), "a", "b")
