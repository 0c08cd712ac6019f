"""Drift correction of captures: consensus planes, offsets of path chunks, a smooth chain of corrections, moved points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graphs as R
from ..operators import histograms as H
from ..operators import joins as J
from ..operators import selection as K
from ..operators import sequences as S
from ..operators.grids import cut

SIDE = ("capture", "axis", "sign")
BOX = [1.0] * 5


def wall_rows(points: DataFrame) -> DataFrame:
    """(capture, frame, axis, sign, c) of points that face along x (axis 0) or z (axis 1)."""
    sides = F.array(F.struct(F.lit(0).alias("axis"), F.col("x").alias("c"), F.col("nx").alias("n")), F.struct(F.lit(1).alias("axis"), F.col("z").alias("c"), F.col("nz").alias("n")))
    rows = points.select("capture", "frame", F.explode(sides).alias("s")).where(F.abs(F.col("s.n")) > 0.9)
    return rows.select("capture", "frame", "s.axis", F.signum("s.n").cast("int").alias("sign"), "s.c")


def consensus_planes(walls: DataFrame, least: int = 200, bin_size: float = 0.01) -> DataFrame:
    """(capture, axis, sign, anchor): peaks of the coordinate's histogram, smoothed over five bins, of the sides with `least` points; more than least / 10 points a bin."""
    low = walls.groupBy(*SIDE).agg((F.min("c") - 0.05).alias("lo"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    rows = walls.join(low, list(SIDE)).select(*SIDE, "lo", (F.col("c") - F.col("lo")).alias("d"))
    smoothed = H.smooth(H.dense_histogram(rows.select(*SIDE, "d"), "d", bin_size, keys=SIDE, anchor=0.0, pad=4), BOX, keys=SIDE)
    found = H.peaks(smoothed, bin_size, F.lit(least / 10.0), keys=SIDE)
    return found.join(low, list(SIDE)).select(*SIDE, (F.col("level") + F.col("lo")).alias("anchor"))


def plane_offsets(walls: DataFrame, anchors: DataFrame, reach: float = 0.08) -> DataFrame:
    """Adds `offset`: the signed distance to the nearest plane of the same side, where one is within `reach`."""
    return J.nearest_anchor(walls, anchors, "c", "anchor", SIDE, reach).where(F.col("offset").isNotNull())


def sharpness(points: DataFrame) -> DataFrame:
    """(capture, spread): how far wall points scatter about their consensus planes, 1.4826 times the median distance."""
    walls = wall_rows(points)
    near = plane_offsets(walls, consensus_planes(walls))
    return near.groupBy("capture").agg((F.percentile(F.abs("offset"), 0.5) * 1.4826).alias("spread"))


def floor_levels(points: DataFrame, bin_size: float = 0.02) -> DataFrame:
    """(capture, floor_y): the lowest strong level of upward points, refitted."""
    up = points.where("ny > 0.9").select("capture", "y")
    low = up.groupBy("capture").agg((F.min("y") - 0.05).alias("lo"))
    rows = up.join(low, "capture").select("capture", (F.col("y") - F.col("lo")).alias("d"))
    found = H.peaks(H.smooth(H.dense_histogram(rows, "d", bin_size, keys=("capture",), anchor=0.0, pad=4), [1.0, 2.0, 3.0, 2.0, 1.0], keys=("capture",)), bin_size, F.lit(0.0), keys=("capture",))
    big = found.groupBy("capture").agg(F.max("s").alias("_big"))
    first = found.join(big, "capture").where(F.col("s") > F.col("_big") * 0.25).groupBy("capture").agg(F.min("level").alias("level"))
    guess = first.join(low, "capture").select("capture", (F.col("level") + F.col("lo")).alias("guess"))
    near = up.join(guess, "capture").where(F.abs(F.col("y") - F.col("guess")) < 0.04)
    return H.robust_level(near, "y", "guess", 0.04, keys=("capture",)).select("capture", F.col("level").alias("floor_y"))


def chunk_offsets(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """(capture, chunk, dof, m, w) for every chunk: what was measured of its yaw (0), height (1), x (2) and z (3), with weights; 0 and weight 0 where too little was seen.

    Yaw: the fourfold mean of horizontal normals, of more than 300, under 20 degrees and clearer than 0.4; height: upward points within
    0.1 of the floor, more than 200; x and z: the median offset to consensus planes, of 200 or more.
    """
    owned = points.join(chunks.select("capture", "frame", "chunk"), ["capture", "frame"])
    enough = owned.groupBy("capture", "chunk").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 200").drop("_n")
    weight = lambda n: F.least(n / 2000.0, F.lit(5.0))
    angle = F.atan2("nz", "nx") * 4
    yaw = owned.where("abs(ny) < 0.2").groupBy("capture", "chunk").agg(F.avg(F.cos(angle)).alias("c"), F.avg(F.sin(angle)).alias("s"), F.count(F.lit(1)).alias("n"))
    yaw = yaw.select("capture", "chunk", "n", (F.atan2("s", "c") / 4).alias("m"), F.hypot("c", "s").alias("r")).where("n > 300 and abs(m) < 0.3490658503988659 and r > 0.4")
    yaw = yaw.select("capture", "chunk", F.lit(0).alias("dof"), "m", (weight(F.col("n")) * F.col("r")).alias("w"))
    floor = owned.where("ny > 0.9").join(floor_levels(points), "capture").where("abs(y - floor_y) < 0.1").groupBy("capture", "chunk").agg(F.percentile(F.col("y") - F.col("floor_y"), 0.5).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 200")
    floor = floor.select("capture", "chunk", F.lit(1).alias("dof"), "m", weight(F.col("n")).alias("w"))
    walls = wall_rows(points)
    near = plane_offsets(walls, consensus_planes(walls)).join(chunks.select("capture", "frame", "chunk"), ["capture", "frame"])
    flat = near.groupBy("capture", "chunk", "axis").agg(F.percentile("offset", 0.5).alias("m"), F.count(F.lit(1)).alias("n")).where("n >= 200")
    flat = flat.select("capture", "chunk", (F.col("axis") + 2).alias("dof"), "m", weight(F.col("n")).alias("w"))
    seen = yaw.unionByName(floor).unionByName(flat).join(enough, ["capture", "chunk"], "left_semi")
    every = chunks.select("capture", "chunk").distinct().withColumn("dof", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    return every.join(seen, ["capture", "chunk", "dof"], "left").select("capture", "chunk", "dof", F.coalesce("m", F.lit(0.0)).alias("m"), F.coalesce("w", F.lit(0.0)).alias("w"))


def chunk_corrections(offsets: DataFrame, lam: float = 4.0, lam_yaw: float = 8.0) -> DataFrame:
    """(capture, chunk, dof, x): the smooth chain that takes the offsets back, without its weighted mean, so that the map does not slide."""
    parts = [R.smooth_chain(offsets.where(F.col("dof") == 0) if yaw else offsets.where(F.col("dof") > 0), ("capture", "dof"), "chunk", "m", "w", lam_yaw if yaw else lam) for yaw in (True, False)]
    turned = parts[0].unionByName(parts[1]).withColumn("x", -F.col("x"))
    return K.weighted_gauge(turned, ("capture", "dof"), "x", "w").select("capture", "chunk", "dof", "x")


def frame_corrections(chunks: DataFrame, corrections: DataFrame) -> DataFrame:
    """(capture, frame, dof, x): corrections at each frame, by straight lines between the middles of chunks along the path."""
    middle = chunks.groupBy("capture", "chunk").agg(F.avg("path").alias("path"))
    known = corrections.join(middle, ["capture", "chunk"]).select("capture", "dof", "path", "x")
    asked = chunks.select("capture", "frame", "path", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("dof"))
    return S.interpolate(asked, known, "path", "x", ("capture", "dof")).select("capture", "frame", "dof", "x")


def moved(points: DataFrame, frames: DataFrame, by_frame: DataFrame) -> DataFrame:
    """Points turned about their frame's camera by the frame's yaw and then shifted; normals turned."""
    wide = by_frame.groupBy("capture", "frame").agg(*[F.max(F.when(F.col("dof") == k, F.col("x"))).alias(f"_{n}") for k, n in enumerate(("yaw", "y", "x", "z"))])
    rows = points.join(frames.select("capture", "frame", F.col("cx").alias("_px"), F.col("cz").alias("_pz")).join(wide, ["capture", "frame"]), ["capture", "frame"])
    c, s = F.cos("_yaw"), F.sin("_yaw")
    dx, dz = F.col("x") - F.col("_px"), F.col("z") - F.col("_pz")
    return rows.withColumns({
        "x": F.col("_px") + c * dx - s * dz + F.col("_x"), "z": F.col("_pz") + s * dx + c * dz + F.col("_z"), "y": F.col("y") + F.col("_y"),
        "nx": c * F.col("nx") - s * F.col("nz"), "nz": s * F.col("nx") + c * F.col("nz")}).select(*points.columns)


def correct_drift(points: DataFrame, frames: DataFrame, iterations: int = 3, chunk_length: float = 1.0, least: int = 6) -> DataFrame:
    """Points (capture, frame, x, y, z, nx, ny, nz) with the drift along each capture's path (capture, frame, cx, cy, cz) taken out.

    Every iteration measures the offsets of path chunks to what all of the capture agrees on, solves a
    smooth chain for each degree of freedom and moves the points; it is written to the shared folder.
    """
    walked = S.path_length(frames, ["cx", "cy", "cz"], ["frame"], ("capture",))
    chunks = cut(S.path_chunks(walked, ["frame"], ("capture",), length=chunk_length, least=least).select("capture", "frame", "path", "chunk"))
    now = cut(points)
    for _ in range(iterations):
        corrections = cut(chunk_corrections(cut(chunk_offsets(now, chunks))))
        now = cut(moved(now, frames, frame_corrections(chunks, corrections)))
    return now


def halves_spread(points: DataFrame, frames: DataFrame) -> DataFrame:
    """(capture, spread): how far the floor levels of the first and the second half of a capture's frames are apart."""
    n = F.count(F.lit(1)).over(Window.partitionBy("capture"))
    half = frames.withColumn("_k", F.row_number().over(Window.partitionBy("capture").orderBy("frame")) - 1).withColumn("half", F.when(F.col("_k") < F.floor(n / 2), 0).otherwise(1)).select("capture", "frame", "half")
    each = points.join(half, ["capture", "frame"]).withColumn("capture", F.concat_ws("/", "capture", "half"))
    levels = floor_levels(each).withColumn("half", F.substring_index("capture", "/", -1)).withColumn("capture", F.expr("substring(capture, 1, length(capture) - 2)"))
    return levels.groupBy("capture").agg((F.max("floor_y") - F.min("floor_y")).alias("spread"))
