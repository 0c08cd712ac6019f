"""Exact overlay of polygons, and consistency of views by the overlap of their hulls."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import chain


def _rising(rings: DataFrame, keys: tuple[str, ...], side: int) -> DataFrame:
    """Edges (x1, z1, x2, z2) from left to right; upright ones hold no area under them."""
    left = F.col("x1") < F.col("x2")
    ends = {"xa": ("x1", "x2"), "za": ("z1", "z2"), "xb": ("x2", "x1"), "zb": ("z2", "z1")}
    return rings.where("x1 <> x2").select(*keys, F.lit(side).alias("side"), *[F.when(left, F.col(p)).otherwise(F.col(q)).cast("double").alias(n) for n, (p, q) in ends.items()])


def overlay(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, area_a, area_b, common, joint): areas of two polygons of each key, of their intersection and of their union, exact up to rounding.

    Polygons are edges (x1, z1, x2, z2) in any order, convex or not, of one or many rings; what an
    odd number of edges lies below is inside. A sweep over x: strips end at every corner and at
    every crossing of an edge of `a` with one of `b`, so inside a strip edges keep their order and
    each layer between two of them is a trapezoid, whose area is its width times its middle height.
    Edges are dealt to as many bins of x as the key has edges, so that edges meet only where they
    overlap in x, and a strip meets the edges of its own bin. A key with one polygon only has
    common = 0; one with upright edges only has no row.
    """
    e = _rising(a, keys, 0).unionByName(_rising(b, keys, 1))
    box = e.groupBy(*keys).agg(F.min("xa").alias("_x0"), F.max("xb").alias("_x1"), F.count(F.lit(1)).alias("_n"))
    e = e.join(box, list(keys))
    bin_of = lambda x: F.least(F.floor((x - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * F.col("_n")), F.col("_n") - 1)
    e = e.withColumn("s", (F.col("zb") - F.col("za")) / (F.col("xb") - F.col("xa"))).withColumn("bin", F.explode(F.sequence(bin_of(F.col("xa")), bin_of(F.col("xb")))))

    one = e.where("side = 0").select(*keys, "bin", *[F.col(c).alias(f"p_{c}") for c in ("xa", "za", "xb", "s")])
    two = e.where("side = 1").select(*keys, "bin", *[F.col(c).alias(f"q_{c}") for c in ("xa", "za", "xb", "s")])
    at = ((F.col("q_za") - F.col("q_s") * F.col("q_xa")) - (F.col("p_za") - F.col("p_s") * F.col("p_xa"))) / F.nullif(F.col("p_s") - F.col("q_s"), F.lit(0.0))
    crossings = one.join(two, [*keys, "bin"]).select(*keys, F.greatest("p_xa", "q_xa").alias("lo"), F.least("p_xb", "q_xb").alias("hi"), at.alias("x")).where("x > lo and x < hi").select(*keys, "x")
    corners = e.select(*keys, F.explode(F.array("xa", "xb")).alias("x"))
    cuts = corners.unionByName(crossings).distinct()
    strips = cuts.select(*keys, F.col("x").alias("lo"), F.lead("x").over(Window.partitionBy(*keys).orderBy("x")).alias("hi")).where("hi is not null")
    middle = (F.col("lo") + F.col("hi")) / 2
    strips = strips.join(box, list(keys)).withColumn("bin", bin_of(middle)).drop("_x0", "_x1", "_n")

    met = strips.join(e.select(*keys, "bin", "side", "xa", "za", "xb", "s"), [*keys, "bin"]).where("xa <= lo and xb >= hi")
    met = met.select(*keys, "lo", "hi", "side", (F.col("za") + F.col("s") * (middle - F.col("xa"))).alias("y"))
    order = Window.partitionBy(*keys, "lo").orderBy("y", "side")
    below = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    layers = met.select(*keys, ((F.col("hi") - F.col("lo")) * (F.lead("y").over(order) - F.col("y"))).alias("v"), (F.sum(1 - F.col("side")).over(below) % 2 == 1).alias("in_a"), (F.sum("side").over(below) % 2 == 1).alias("in_b"))
    area = lambda c: F.coalesce(F.sum(F.when(c, F.col("v"))), F.lit(0.0))
    return layers.groupBy(*keys).agg(area(F.col("in_a")).alias("area_a"), area(F.col("in_b")).alias("area_b"), area(F.col("in_a") & F.col("in_b")).alias("common"), area(F.col("in_a") | F.col("in_b")).alias("joint"))


def rings_iou(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, iou): common over joint area of two polygons of each key (edges x1, z1, x2, z2)."""
    return overlay(a, b, keys).where("joint > 0").select(*keys, (F.col("common") / F.col("joint")).alias("iou"))


def padded_rings(points: DataFrame, keys: tuple[str, ...], x: str, z: str, pad: float, directions: int = 64) -> DataFrame:
    """(keys, xs, zs): each key's convex hull, counter-clockwise, widened by `pad` on all sides: its sum with a regular polygon of `directions` corners instead of a disc, which misses pad * (1 - cos(pi / directions)) at most.

    A key's points (a view's) are one row, and many rows go through Python at once: keys are many and small. Points with a null take no part.
    """
    turns = [(pad * math.cos(2 * math.pi * k / directions), pad * math.sin(2 * math.pi * k / directions)) for k in range(directions)]
    spot = F.when(F.col(x).isNotNull() & F.col(z).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(z).cast("double").alias("z")))
    some = points.groupBy(*keys).agg(F.collect_set(spot).alias("_p")).select(*keys, F.col("_p.x").alias("_x"), F.col("_p.z").alias("_z")).where(F.size("_x") > 0)

    @F.pandas_udf("struct<xs: array<double>, zs: array<double>>")
    def widened(xs: pd.Series, zs: pd.Series) -> pd.DataFrame:
        rings = [chain((px + dx, pz + dz) for px, pz in chain(zip(a.tolist(), b.tolist(), strict=True)) for dx, dz in turns) for a, b in zip(xs, zs, strict=True)]
        return pd.DataFrame({"xs": [[p[0] for p in r] for r in rings], "zs": [[p[1] for p in r] for r in rings]})

    return some.withColumn("_r", widened("_x", "_z")).select(*keys, "_r.xs", "_r.zs")


def padded_hulls(points: DataFrame, keys: tuple[str, ...], x: str, z: str, pad: float, directions: int = 64) -> DataFrame:
    """(keys, corner, x, z): the corners of `padded_rings`."""
    return padded_rings(points, keys, x, z, pad, directions).select(*keys, F.posexplode(F.arrays_zip("xs", "zs")).alias("corner", "_p")).select(*keys, "corner", F.col("_p.xs").alias("x"), F.col("_p.zs").alias("z"))


def _stacked(rings: pd.Series) -> np.ndarray:
    """Rings of one coordinate under each other; shorter ones repeat their last corner."""
    size = rings.map(len).to_numpy()
    return np.concatenate(rings.to_list())[(np.cumsum(size) - size)[:, None] + np.minimum(np.arange(size.max()), size[:, None] - 1)]


def _border_inside(a: np.ndarray, b: np.ndarray, own: bool, near: float = 1e-10) -> np.ndarray:
    """Twice the area under the edges of convex rings `a` (row, corner, 2) within `b`, by clipping each by all edges of `b`. Edges on one line count if `own` and both rings lie on one side."""
    p, d = a, np.roll(a, -1, axis=1) - a
    e = np.roll(b, -1, axis=1) - b
    length = np.hypot(e[..., 0], e[..., 1])
    edge = length > 0
    nx, nz = -e[..., 1] / np.where(edge, length, 1), e[..., 0] / np.where(edge, length, 1)  # inward
    first = (p[:, :, None, 0] - b[:, None, :, 0]) * nx[:, None] + (p[:, :, None, 1] - b[:, None, :, 1]) * nz[:, None]
    rise = d[:, :, None, 0] * nx[:, None] + d[:, :, None, 1] * nz[:, None]
    on = (np.abs(first) <= near) & (np.abs(first + rise) <= near) & edge[:, None]
    same = d[:, :, None, 0] * e[:, None, :, 0] + d[:, :, None, 1] * e[:, None, :, 1] > 0
    cuts = edge[:, None] & ~on
    at = -first / np.where(rise == 0, 1, rise)
    low = np.where(cuts & (rise > 0), at, 0.0).max(axis=2)
    high = np.where(cuts & (rise < 0), at, 1.0).min(axis=2)
    out = ((cuts & (rise == 0) & (first < 0)) | (on & ~(same & own))).any(axis=2) | (low >= high)
    return np.where(out, 0.0, (p[..., 0] * d[..., 1] - p[..., 1] * d[..., 0]) * (high - low)).sum(axis=1)


def convex_iou(ax: pd.Series, az: pd.Series, bx: pd.Series, bz: pd.Series) -> np.ndarray:
    """Common over joint area of pairs of convex counter-clockwise rings: the border of what is common is each ring's border within the other. NaN where both areas are 0."""
    found = []
    for at in range(0, len(ax), 512):
        a, b = (np.stack([_stacked(x.iloc[at : at + 512]), _stacked(z.iloc[at : at + 512])], axis=-1) for x, z in ((ax, az), (bx, bz)))
        a, b = a - a[:, :1], b - a[:, :1]
        one, two = ((r[..., 0] * np.roll(r[..., 1], -1, axis=1) - np.roll(r[..., 0], -1, axis=1) * r[..., 1]).sum(axis=1) for r in (a, b))
        both = np.minimum(np.maximum(_border_inside(a, b, True) + _border_inside(b, a, False), 0), np.minimum(one, two))
        joint = one + two - both
        found.append(np.where(joint > 0, both / np.where(joint > 0, joint, 1), np.nan))
    return np.concatenate(found) if found else np.empty(0)


def view_consistency(points: DataFrame, keys: tuple[str, ...], view: str, u: str, v: str, *, pad: float = 0.02, directions: int = 64) -> DataFrame:
    """(keys, n_views, consistency): the mean IoU of the padded hulls of a cluster's views, over all pairs of views; 1 for a single view.

    Only pairs whose bounding boxes overlap are overlaid, the others have an IoU of 0. Their number
    is that of the pairs the mean is over, so it is for clusters of tens or hundreds of views.
    """
    ring = padded_rings(points, (*keys, view), u, v, pad, directions)
    box = ring.select(*keys, view, "xs", "zs", *[f(c).alias(n) for n, f, c in (("x0", F.array_min, "xs"), ("x1", F.array_max, "xs"), ("z0", F.array_min, "zs"), ("z1", F.array_max, "zs"))])
    other = box.select(*keys, *[F.col(c).alias(f"_{c}") for c in (view, "xs", "zs", "x0", "x1", "z0", "z1")])
    pairs = box.join(other, list(keys)).where((F.col(view) < F.col(f"_{view}")) & (F.col("x0") < F.col("_x1")) & (F.col("_x0") < F.col("x1")) & (F.col("z0") < F.col("_z1")) & (F.col("_z0") < F.col("z1")))

    @F.pandas_udf("double")
    def shared(ax: pd.Series, az: pd.Series, bx: pd.Series, bz: pd.Series) -> pd.Series:
        return pd.Series(convex_iou(ax, az, bx, bz))

    iou = pairs.select(*keys, F.nanvl(shared("xs", "zs", "_xs", "_zs"), F.lit(0.0)).alias("_iou")).groupBy(*keys).agg(F.sum("_iou").alias("_sum"))
    n = points.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(*keys, view).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_views"))
    many = F.col("n_views") * (F.col("n_views") - 1) / 2
    return n.join(iou, list(keys), "left").select(*keys, "n_views", F.when(F.col("n_views") == 1, 1.0).otherwise(F.coalesce("_sum", F.lit(0.0)) / many).alias("consistency"))
