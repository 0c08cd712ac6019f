"""Operators on points: voxels, orientation, cells, slabs and rays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measure import affine


def voxel_downsample(points: DataFrame, coords: tuple[str, str, str], voxel: float, extra: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each occupied voxel: the mean of the coordinates and of `extra`, and the number of points. Partial sums are made before the shuffle."""
    cells = [F.floor(F.col(c) / voxel).alias(f"v{c}") for c in coords]
    return points.groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in (*coords, *extra)])


def transform_points(points: DataFrame, poses: DataFrame, key: str, coords=("x", "y", "z"), normals: tuple[str, str, str] | None = None, matrix: str = "pose") -> DataFrame:
    """Points moved by their key's row-major 4x4 pose; normals are turned only. An inner join on the key."""
    m = poses.select(F.col(key), F.col(matrix).alias("_m"))
    moved = dict(zip(coords, affine(F.col("_m"), *[F.col(c) for c in coords]), strict=True))
    if normals:
        moved |= dict(zip(normals, affine(F.col("_m"), *[F.col(c) for c in normals], translate=False), strict=True))
    return points.join(m, key).withColumns(moved).drop("_m")


def backproject(pixels: DataFrame, *, frame: str = "frame", u: str = "u", v: str = "v", depth: str = "z", valid: str = "valid", stride: int = 1) -> DataFrame:
    """Camera points with normals from depth pixels (frame, u, v, z, valid, fx, fy, cx, cy).

    Normals are the cross product of central differences over the four neighbours, turned to the
    camera. Border pixels, pixels with an invalid neighbour, and depth steps of 0.06 * max(z, 0.3)
    or more are dropped; then u and v are kept at multiples of `stride`. Neighbours come from a
    grouping by the pixel they border on, which is one shuffle however large a frame is.
    """
    good = pixels.where(F.col(valid))
    point = F.named_struct(
        F.lit("x"), (F.col(u) - F.col("cx")) / F.col("fx") * F.col(depth), F.lit("y"), (F.col(v) - F.col("cy")) / F.col("fy") * F.col(depth), F.lit("z"), F.col(depth).cast("double"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(du).alias("du"), F.lit(dv).alias("dv")) for i, (du, dv) in enumerate([(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)])])
    spread = good.select(frame, u, v, point.alias("p"), F.explode(steps).alias("s"))
    spread = spread.groupBy(frame, (F.col(u) + F.col("s.du")).alias("u"), (F.col(v) + F.col("s.dv")).alias("v")).agg(
        *[F.max(F.when(F.col("s.i") == i, F.col("p"))).alias(n) for i, n in enumerate(["c", "left", "right", "up", "down"])])
    flat = spread.where(" AND ".join(f"{n} IS NOT NULL" for n in ("c", "left", "right", "up", "down")) + f" AND u % {stride} = 0 AND v % {stride} = 0")
    step = F.greatest(*[F.abs(F.col(f"{n}.z") - F.col("c.z")) for n in ("left", "right", "up", "down")])
    flat = flat.where(step < 0.06 * F.greatest(F.col("c.z"), F.lit(0.3)))
    a = [F.col(f"right.{k}") - F.col(f"left.{k}") for k in "xyz"]
    b = [F.col(f"down.{k}") - F.col(f"up.{k}") for k in "xyz"]
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    toward = F.when(n[0] * F.col("c.x") + n[1] * F.col("c.y") + n[2] * F.col("c.z") > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return flat.where(size > 0).select(frame, "u", "v", F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.col("c.z").alias("z"), *[(k * toward / size).alias(f"n{c}") for k, c in zip(n, "xyz", strict=True)])


def dominant_yaw(normals: DataFrame, nx: str, ny: str, nz: str, weight: Column | None = None, keys: tuple[str, ...] = (), flat: float = 0.2) -> DataFrame:
    """Yaw of the walls modulo a quarter turn: the circular mean of four times the angle of horizontal normals, and its resultant length."""
    w = weight if weight is not None else F.lit(1.0)
    angle = F.atan2(F.col(nz), F.col(nx)) * 4
    sums = normals.where(F.abs(F.col(ny)) < flat).groupBy(*keys).agg(F.sum(w * F.cos(angle)).alias("c"), F.sum(w * F.sin(angle)).alias("s"), F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"))
    total = F.greatest(F.col("w"), F.lit(1e-9))
    return sums.select(*keys, "n", (F.atan2("s", "c") / 4).alias("yaw"), (F.hypot("c", "s") / total).alias("score"))


def cells(points: DataFrame, x: str, z: str, res: float, x0: float = 0.0, z0: float = 0.0) -> DataFrame:
    return points.withColumn("i", F.floor((F.col(x) - x0) / res)).withColumn("j", F.floor((F.col(z) - z0) / res))


def grid_count(points: DataFrame, x: str, z: str, res: float, weight: Column | None = None, x0: float = 0.0, z0: float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points, or the sum of a weight, for each occupied cell."""
    what = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return cells(points, x, z, res, x0, z0).groupBy(*keys, "i", "j").agg(what.alias("n"))


def slab_barrier(points: DataFrame, cell: tuple[str, str], height: Column, edges: list[float], high: tuple[float, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells that block: three or more points in the high band, or two or more points in three or more slabs.

    One aggregation by (cell, slab), a second by cell.
    """
    slab = F.lit(None).cast("int")
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        slab = F.when((height > lo) & (height < hi), F.lit(k)).otherwise(slab)
    per = points.withColumn("slab", slab).withColumn("top", ((height > high[0]) & (height < high[1])).cast("long"))
    per = per.groupBy(*keys, *cell, "slab").agg(F.count(F.lit(1)).alias("n"), F.sum("top").alias("top"))
    full = F.sum(F.when(F.col("slab").isNotNull() & (F.col("n") >= 2), 1).otherwise(0))
    return per.groupBy(*keys, *cell).agg(F.sum("top").alias("wall_hi"), full.cast("long").alias("slabs")).withColumn("barrier", (F.col("wall_hi") >= 3) | (F.col("slabs") >= 3))


def ray_carve(rays: DataFrame, camera: tuple[str, str], hit: tuple[str, str], res: float, least: float = 0.1, short: float = 0.06, keys: tuple[str, ...] = ()) -> DataFrame:
    """How often rays from a camera to a hit pass each cell; a ray stops `short` of its hit and steps by 0.8 cells. Steps stream from explode into partial counts."""
    dx, dz = F.col(hit[0]) - F.col(camera[0]), F.col(hit[1]) - F.col(camera[1])
    rows = rays.withColumn("_len", F.sqrt(dx * dx + dz * dz)).where(F.col("_len") > least)
    rows = rows.withColumn("_n", F.ceil(F.col("_len") / (0.8 * res)).cast("int")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = F.col("_k") / F.col("_n") * (F.col("_len") - short) / F.col("_len")
    return rows.groupBy(*keys, F.floor((F.col(camera[0]) + t * dx) / res).alias("i"), F.floor((F.col(camera[1]) + t * dz) / res).alias("j")).agg(F.count(F.lit(1)).alias("n"))


def capped_rays(rays: DataFrame, frame: str, ident: str, most: int = 400, seed: int = 0) -> DataFrame:
    """At most `most` rays of each frame, by a seeded hash: the sampling operator of the carving step."""
    from pyspark.sql import Window

    order = Window.partitionBy(frame).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string"))), ident)
    return rays.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def band_counts(points: DataFrame, height: Column, ny: Column, top: Column) -> DataFrame:
    """One row: points by orientation (vertical, floor, ceiling, horizontal normals) and in the two height bands of walls under `top`."""
    vertical = F.abs(ny) < 0.3
    return points.agg(
        F.count_if(vertical).alias("vertical"), F.count_if((ny > 0.85) & (F.abs(height) < 0.04)).alias("floor"), F.count_if(ny < -0.85).alias("ceiling"), F.count_if(F.abs(ny) < 0.2).alias("horizontal"),
        F.count_if(vertical & (height > 1.25) & (height < F.least(F.lit(1.95), top - 0.15))).alias("wall_hi"), F.count_if(vertical & (height > 0.1) & (height < top - 0.1)).alias("wall_any"))


def projected(x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Pixel of a camera point; null behind the camera."""
    front = z > 1e-6
    return F.when(front, x / z * fx + cx), F.when(front, y / z * fy + cy)


def gravity(normals: DataFrame, keys: tuple[str, ...], steps: int = 10, near: float = 0.85) -> DataFrame:
    """(keys, gx, gy, gz, n): the mean direction of the normals within `near` of it, signs aligned, from straight up on in `steps` rounds. Each round is one aggregation."""
    up = normals.select(*keys).distinct().select(*keys, F.lit(0.0).alias("gx"), F.lit(1.0).alias("gy"), F.lit(0.0).alias("gz"))
    for _ in range(steps):
        dot = F.col("nx") * F.col("gx") + F.col("ny") * F.col("gy") + F.col("nz") * F.col("gz")
        rows = normals.select(*keys, "nx", "ny", "nz").join(up.select(*keys, "gx", "gy", "gz"), list(keys)).withColumn("_d", dot).where(F.abs("_d") > near)
        sums = rows.groupBy(*keys).agg(*[F.sum(F.signum("_d") * F.col(f"n{c}")).alias(f"_{c}") for c in "xyz"], F.count(F.lit(1)).alias("n"))
        size = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + F.col("_z") * F.col("_z"))
        up = sums.select(*keys, *[(F.col(f"_{c}") / size).alias(f"g{c}") for c in "xyz"], "n")
    return up
