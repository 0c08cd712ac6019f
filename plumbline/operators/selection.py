"""Joins with a band or a box, picks of a few rows, and small statistics of captures and frames."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grids import cut, numbered
from .quantiles import exact_percentiles, settled, with_key_values


def hashed_share(*idents: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that follows the row's identity and a seed: the same in every run and engine (first 32 bits of an MD5)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in idents])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def subsample(df: DataFrame, idents: list[str], most: int, seed: int = 0) -> DataFrame:
    """About `most` rows by a seeded threshold on the identity, all rows if there are no more: a sampling operator."""
    n = df.count()
    return df if n <= most else df.where(hashed_share(*[F.col(c) for c in idents], seed=seed) < most / n)


def bagged(df: DataFrame, idents: list[str], runs: int, drop: float = 0.15) -> DataFrame:
    """Adds `run`: each row in those of `runs` repetitions that do not drop it, by a hash of run and identity."""
    return df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).where(hashed_share(F.col("run"), *[F.col(c) for c in idents]) >= drop)


def in_boxes(points: DataFrame, boxes: DataFrame, x: str, z: str, cell: float) -> DataFrame:
    """Pairs of points and boxes (xmin, xmax, zmin, zmax), half open in x and closed in z: an equality join on cells along x, then the exact test."""
    b = boxes.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("xmin") / cell), F.floor(F.col("xmax") / cell))))
    met = points.withColumn("_cell", F.floor(F.col(x) / cell)).join(b, "_cell").drop("_cell")
    return met.where((F.col(x) >= F.col("xmin")) & (F.col(x) < F.col("xmax")) & (F.col(z) >= F.col("zmin")) & (F.col(z) <= F.col("zmax")))


def _weights_within(x: np.ndarray, z: np.ndarray, w: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The weight of the points in each box (xmin, xmax, zmin, zmax): sorted along x, a box is a few blocks of 1, 2, 4 and so on points, each ordered by z and summed up."""
    order = np.argsort(x, kind="stable")
    x, z, w, n = x[order], z[order], w[order], len(x)
    heights = np.sort(z)
    left, right = (np.searchsorted(x, boxes[:, k], "left") for k in (0, 1))
    low, high = np.searchsorted(heights, boxes[:, 2], "left"), np.searchsorted(heights, boxes[:, 3], "right")
    rank = np.empty(n, np.int64)
    rank[np.argsort(z, kind="stable")] = np.arange(n)
    found, at, level = np.zeros(len(boxes), np.int64), np.arange(n), 0
    live = np.flatnonzero((left < right) & (low < high))
    while len(live):
        key = (at >> level) * n + rank[at]
        sort = np.argsort(key, kind="stable")  # two ordered halves of each block
        at, key = at[sort], key[sort]
        upto = np.concatenate([[0], np.cumsum(w[at])])
        for k, odd in ((left, 0), (right, -1)):
            some = live[(k[live] & 1) == 1]
            block = (k[some] + odd) * n
            found[some] += upto[np.searchsorted(key, block + high[some])] - upto[np.searchsorted(key, block + low[some])]
        left, right, level = (left + 1) >> 1, right >> 1, level + 1
        live = live[left[live] < right[live]]
    return found


def counts_in_boxes(points: DataFrame, boxes: DataFrame, ident: str, x: str, z: str, cell: float, most: int = 500_000) -> DataFrame:
    """(ident, n): points in each box that holds any, as `in_boxes` finds them, without a row for each pair.

    Points in one place are counted before they meet the boxes, and boxes in one place meet them once. Cells along x make slabs of about
    `most` places; a fuller slab is dealt to parts by a hash. Each part counts what it holds of the boxes that reach into its slab.
    """
    place = ["xmin", "xmax", "zmin", "zmax"]
    boxes = boxes.select(ident, *[F.col(c).cast("double").alias(c) for c in place])
    points = points.select(F.col(x).cast("double").alias("x"), F.col(z).cast("double").alias("z")).where("x is not null and z is not null")
    cells = points.groupBy(F.floor(F.col("x") / cell).alias("_cell")).agg(F.approx_count_distinct(F.xxhash64("x", "z")).alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    slabs = cells.withColumn("_slab", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / most))
    slabs = settled(slabs.select("_cell", "_slab", F.ceil(F.sum("_n").over(Window.partitionBy("_slab")) / most).cast("int").alias("_parts")))
    spots = points.groupBy("x", "z").agg(F.count(F.lit(1)).alias("_n")).withColumn("_cell", F.floor(F.col("x") / cell)).join(slabs, "_cell")
    spots = spots.select("_slab", F.pmod(F.xxhash64("x", "z"), F.col("_parts")).cast("int").alias("_part"), "x", "z", "_n")
    asked = boxes.select(*place).distinct().where("xmin < xmax and zmin <= zmax").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("xmin") / cell), F.floor(F.col("xmax") / cell)))).join(slabs, "_cell")
    asked = asked.select("_slab", "_parts", *place).distinct().select(F.col("_slab").alias("_slab"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), *place)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        n = _weights_within(*(left[c].to_numpy() for c in ("x", "z", "_n")), np.stack([right[c].to_numpy() for c in place], axis=1))
        return pa.table({**{c: right[c] for c in place}, "n": pa.array(n)}).filter(pa.array(n > 0))

    n = spots.groupBy("_slab", "_part").cogroup(asked.groupBy("_slab", "_part")).applyInArrow(count, ", ".join([*(f"{c} double" for c in place), "n long"])).groupBy(*place).agg(F.sum("n").alias("n"))
    return boxes.join(n, place).groupBy(ident).agg(F.sum("n").alias("n"))


def near_edges(points: DataFrame, ident: str, px: str, pz: str, edges: DataFrame, keys: tuple[str, ...], margin: float, cell: float, within: tuple[str, ...] = ()) -> DataFrame:
    """(ident, keys) of points within `margin` of an edge (x1, z1, x2, z2): edges enter the cells that they pass with the margin, then the distance to the segment decides."""
    low, high = F.least("z1", "z2"), F.greatest("z1", "z2")
    e = edges.withColumn("_row", F.explode(F.sequence(F.floor((low - margin) / cell), F.floor((high + margin) / cell))))
    # the part of the edge that a point of the row can be near to, a little widened: rounding must not lose a cell
    ends = [F.least(F.greatest(F.col("_row") * cell - margin, low), high), F.least(F.greatest((F.col("_row") + 1) * cell + margin, low), high)]
    at = [F.when(high - low > 1e-6, F.col("x1") + (F.col("x2") - F.col("x1")) * (z - F.col("z1")) / (F.col("z2") - F.col("z1"))).otherwise(x) for z, x in zip(ends, (F.col("x1"), F.col("x2")), strict=True)]
    wide = margin + 1e-6
    e = e.withColumn("_column", F.explode(F.sequence(F.floor((F.least(*at) - wide) / cell), F.floor((F.greatest(*at) + wide) / cell))))
    dx, dz = F.col("x2") - F.col("x1"), F.col("z2") - F.col("z1")
    t = ((F.col(px) - F.col("x1")) * dx + (F.col(pz) - F.col("z1")) * dz) / F.greatest(dx * dx + dz * dz, F.lit(1e-12))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    gx, gz = F.col(px) - (F.col("x1") + t * dx), F.col(pz) - (F.col("z1") + t * dz)
    met = points.withColumns({"_row": F.floor(F.col(pz) / cell), "_column": F.floor(F.col(px) / cell)}).join(e, [*within, "_row", "_column"])
    return met.where(gx * gx + gz * gz <= margin * margin).select(ident, *keys).distinct()


def within_margin(points: DataFrame, ident: str, px: str, pz: str, edges: DataFrame, keys: tuple[str, ...], margin: float, cell: float) -> DataFrame:
    """(ident, keys): points inside a polygon or within `margin` of its border."""
    from .geometry import spots_in_polygons

    inside = spots_in_polygons(points, edges, keys, ident, px, pz, cell)
    return inside.unionByName(near_edges(points, ident, px, pz, edges, keys, margin, 4 * margin)).distinct()


def first_match(pairs: DataFrame, ident: str, order: str) -> DataFrame:
    """The match of each point that comes first in `order`: the room that a frame is in."""
    return pairs.groupBy(ident).agg(F.min(order).alias(order))


def rank01(df: DataFrame, keys: tuple[str, ...], value: str, tie: str) -> DataFrame:
    """Adds `rank01`: k / max(1, n - 1) of each key's rows by value, ties by `tie`. Rows are numbered in ranges, so a key's rows lie in many tasks."""
    rows = numbered(df, [*keys, value, tie], "_at")
    ends = rows.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return with_key_values(rows, ends, keys).withColumn("rank01", (F.col("_at") - F.col("_first")) / F.greatest(F.lit(1), F.col("_n") - 1)).drop("_at", "_first", "_n")


def above_percentile(df: DataFrame, keys: tuple[str, ...], value: str, share: float = 0.25) -> DataFrame:
    """Rows at or above their key's percentile."""
    floor = exact_percentiles(df, keys, value, [share]).select(*keys, F.col("p")[0].alias("_least"))
    return with_key_values(df, floor, keys).where(F.col(value) >= F.col("_least")).drop("_least")


def every_nth(df: DataFrame, keys: tuple[str, ...], order: list[str], fps: float, target: float = 3.0) -> DataFrame:
    """Rows whose place in their key is a multiple of max(1, round(fps / target)): an even down-sample of frames."""
    step = max(1, round(fps / target))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_i", place).where(F.col("_i") % step == 0).drop("_i")


def with_default_first(rows: DataFrame, walls: DataFrame, key: str, wall: str) -> DataFrame:
    """Rows with a wall of their room: their own if the room has it, else the room's first (a left join on both, then the default)."""
    first = walls.groupBy(key).agg(F.min(wall).alias("_first"))
    own = walls.select(key, F.col(wall)).withColumn("_known", F.lit(True)).distinct()
    return rows.join(own, [key, wall], "left").join(first, key, "left").withColumn(wall, F.when(F.col("_known"), F.col(wall)).otherwise(F.col("_first"))).drop("_known", "_first")


def band_neighbours(points: DataFrame, ident: str, coords: tuple[str, str], near: float, far: float, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(ident, other, dist, rank): of the points more than `near` and less than `far` away, the k nearest; the band is applied before the choice. Cells of `far`."""
    x, z = coords
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = points.select(*keys, ident, F.col(x).alias("_x"), F.col(z).alias("_z"), F.floor(F.col(x) / far).alias("_i"), F.floor(F.col(z) / far).alias("_j"))
    b = points.select(*keys, F.col(ident).alias("other"), F.col(x).alias("_ox"), F.col(z).alias("_oz"), F.explode(steps).alias("_s"))
    b = b.withColumn("_i", F.floor(F.col("_ox") / far) + F.col("_s.i")).withColumn("_j", F.floor(F.col("_oz") / far) + F.col("_s.j")).drop("_s")
    dx, dz = F.col("_x") - F.col("_ox"), F.col("_z") - F.col("_oz")
    met = a.join(b, [*keys, "_i", "_j"]).where(F.col(ident) != F.col("other")).withColumn("dist", F.round(F.sqrt(dx * dx + dz * dz), 9)).where((F.col("dist") > near) & (F.col("dist") < far))
    best = Window.partitionBy(ident).orderBy("dist", "other")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*keys, ident, "other", "dist", "rank")


def loop_closures(frames: DataFrame, key: str, place: str, coords: tuple[str, str], accept: Column, *, radius: float = 1.2, gap: int = 15, anchors: int = 5, most: int = 2) -> DataFrame:
    """(key, place, other, dist): frames that close a loop with an earlier one at least `gap` places before.

    Candidates are earlier frames within `radius`, the nearest first, and then up to `anchors` evenly
    spaced earlier ones; of those that `accept` (over place, other, dist) takes, the first `most` stay.

    Cells are three radii wide, so that an earlier frame enters about three of them; a frame lies in one, in which the first
    `most` of its near candidates are chosen before they move. Each (key, place) is one frame.
    """
    x, z = coords
    wide = 3 * radius
    cells_of = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius * 1.000001) / wide), F.floor((F.col(c) + radius * 1.000001) / wide)))
    a = frames.select(key, place, F.col(x).alias("_x"), F.col(z).alias("_z"))
    b = frames.select(key, F.col(place).alias("other"), F.col(x).alias("_ox"), F.col(z).alias("_oz"))
    cells = b.withColumn("_i", cells_of("_ox")).withColumn("_j", cells_of("_oz"))
    dist = F.round(F.sqrt((F.col("_x") - F.col("_ox")) ** 2 + (F.col("_z") - F.col("_oz")) ** 2), 9)
    near = a.withColumn("_i", F.floor(F.col("_x") / wide)).withColumn("_j", F.floor(F.col("_z") / wide)).join(cells, [key, "_i", "_j"])
    near = near.where(F.col("other") <= F.col(place) - gap).withColumn("dist", dist).where(F.col("dist") < radius).where(accept).select(key, "_i", "_j", place, "other", "dist", F.lit(0).alias("_late"))
    inside = Window.partitionBy(key, "_i", "_j", place).orderBy("dist", "other")  # as the join's rows lie: nothing moves
    near = near.withColumn("_r", F.row_number().over(inside)).where(F.col("_r") <= most).drop("_r", "_i", "_j")
    spots = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(anchors - 1)), lambda k: F.floor(k * (F.col(place) - gap) / max(1, anchors - 1)).cast("long")))
    far = a.where(F.col(place) >= gap).withColumn("other", F.explode(spots)).join(b, [key, "other"]).withColumn("dist", dist).where(accept)
    far = far.where(~F.coalesce(F.col("dist") < radius, F.lit(False))).select(key, place, "other", "dist", F.lit(1).alias("_late"))  # a nearer one is among the candidates before
    order = Window.partitionBy(key, place).orderBy("_late", F.when(F.col("_late") == 0, F.col("dist")), "other")
    return near.unionByName(far).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select(key, place, "other", "dist")


def door_pairs(doors: DataFrame, *, width: float = 0.35, facing: float = -0.6) -> DataFrame:
    """(room_a, room_b, door_a, door_b, turns, diff): for each pair of rooms the two doors, and the quarter turn of the second room, that fit best.

    `doors` (room, door, nx, nz outward normal, width). Widths differ by at most `width` and the
    turned normals face each other; the least difference of widths wins, then the first turn and doors.
    The least difference is between neighbours in the order of both rooms' widths, so a door is one row for each other room; only doors that
    differ by just that much then meet. A pair of rooms whose neighbours do not face each other is ordered again for each two sides that do.
    """
    side, pair = ["nx", "nz"], ["room_a", "room_b"]
    doors = cut(doors.where(F.col("room").isNotNull() & (F.abs("width") < float("inf"))).groupBy("room", *side, "width").agg(F.min("door").alias("door")))  # of a room's doors of one width and side only the first can win
    turns = [(1, 0), (0, 1), (-1, 0), (0, -1)]
    dot = lambda a, b, c, s: a["nx"] * (b["nx"] * float(c) - b["nz"] * float(s)) + a["nz"] * (b["nx"] * float(s) + b["nz"] * float(c))
    fits = lambda a, b: reduce(lambda x, y: x | y, [F.coalesce(dot(a, b, c, s) <= facing, F.lit(False)) for c, s in turns])

    def least(rows: DataFrame, keys: list[str]) -> DataFrame:
        """`near` and `diff`: the least difference of neighbours in the order of widths of which one is of either room, and of those that also face each other."""
        own = F.struct("room", "width", *side)
        met = rows.withColumn("_a", F.lag(own).over(Window.partitionBy(*keys).orderBy("width", "room"))).withColumn("_b", own).where("_a.room <> _b.room")
        apart = F.round(F.col("_b.width") - F.col("_a.width"), 9)
        first = F.col("_a.room") == F.col("room_a")
        facing_ = F.when(first, fits(F.col("_a"), F.col("_b"))).otherwise(fits(F.col("_b"), F.col("_a")))
        return met.groupBy(*pair).agg(F.min(apart).alias("near"), F.min(F.when(facing_, apart)).alias("diff")).where(F.col("near") <= width)

    rooms = doors.select("room").distinct()
    pairs = rooms.select(F.col("room").alias("room_a")).join(rooms.select(F.col("room").alias("room_b")), F.col("room_a") < F.col("room_b"))
    both = lambda df: df.withColumn("room", F.explode(F.array(*pair)))
    found = cut(least(both(pairs).join(doors, "room"), pair))
    sides = doors.select("room", F.struct(*side).alias("_side")).distinct()
    open_ = found.where("diff is null or diff > near").select(*pair)
    for r in pair:
        open_ = open_.join(sides.select(F.col("room").alias(r), F.col("_side").alias(f"_{r}")), r)
    open_ = open_.where(fits(F.col("_room_a"), F.col("_room_b")))
    again = open_.withColumn("_s", F.explode(F.array(*[F.struct(F.col(r).alias("room"), F.col(f"_{r}.nx").alias("nx"), F.col(f"_{r}.nz").alias("nz")) for r in pair])))
    again = again.select(*pair, "_room_a", "_room_b", "_s.*").join(doors, ["room", *side])
    settled_ = found.where("diff = near").unionByName(least(again, [*pair, "_room_a", "_room_b"])).where(F.col("diff") <= width).select(*pair, "diff")

    fine = 1e-8  # some roundings wide
    ends = {s: doors.select(F.col("room").alias(f"room_{s}"), F.col("door").alias(f"door_{s}"), F.col("width").alias(f"width_{s}"), F.struct(*side).alias(f"_{s}")) for s in "ab"}
    a = ends["a"].join(settled_, "room_a").withColumn("_at", F.explode(F.array_distinct(F.array(F.col("width_a") - F.col("diff"), F.col("width_a") + F.col("diff"))))).withColumn("_cell", F.floor(F.col("_at") / fine))
    b = ends["b"].withColumn("_cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("width_b") / fine) + k)))
    met = a.join(b, ["room_b", "_cell"]).where(F.round(F.abs(F.col("width_a") - F.col("width_b")), 9) == F.col("diff"))
    met = met.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(k).alias("turns"), dot(F.col("_a"), F.col("_b"), c, s).alias("dot")) for k, (c, s) in enumerate(turns)]))).where(F.col("_t.dot") <= facing)
    best = met.groupBy(*pair).agg(F.min(F.struct("diff", F.col("_t.turns").alias("turns"), "door_a", "door_b")).alias("m"))
    return best.select(*pair, "m.door_a", "m.door_b", "m.turns", "m.diff")


def weighted_gauge(df: DataFrame, keys: tuple[str, ...], value: str, weight: str) -> DataFrame:
    """`value` without its weighted mean by key, where the weights have a positive sum."""
    mean = df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.nullif(F.sum(weight), F.lit(0.0))).alias("_m"))
    return df.join(mean, list(keys)).withColumn(value, F.col(value) - F.coalesce("_m", F.lit(0.0))).drop("_m")


def recentred(df: DataFrame, keys: tuple[str, ...], scale: str, others: tuple[str, ...] = ()) -> DataFrame:
    """`scale` and `others` divided by the key's median scale."""
    middle = settled(exact_percentiles(df, keys, scale, [0.5]).select(*keys, F.col("p")[0].alias("_m")))
    return with_key_values(df, middle, keys).withColumns({c: F.col(c) / F.col("_m") for c in (scale, *others)}).drop("_m")


def median_scale(ratios: DataFrame, keys: tuple[str, ...], ratio: str, low: float = 0.2, high: float = 5.0, least: int = 15) -> DataFrame:
    """(keys, n, scale): the median of the plausible ratios, of keys with enough of them."""
    kept = ratios.where((F.col(ratio) > low) & (F.col(ratio) < high))
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile(ratio, 0.5).alias("scale")).where(F.col("n") >= least)


def quarter_turns(frames: DataFrame, keys: tuple[str, ...], gx: str, gy: str) -> DataFrame:
    """(keys, turns, n): the quarter turn that most frames have, by the largest of (gy, gx, -gy, -gx); of equals the least."""
    sides = F.array(F.col(gy), F.col(gx), -F.col(gy), -F.col(gx))
    own = (F.array_position(sides, F.array_max(sides)) - 1).cast("int")
    votes = frames.groupBy(*keys, own.alias("turns")).agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(*keys).agg(F.max_by("turns", F.struct("n", -F.col("turns"))).alias("turns"), F.max("n").alias("n"))


def clean_rate(found: DataFrame, walls: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, n, area, rate): false hits for each square metre of clean wall (length, height)."""
    area = walls.groupBy(*keys).agg(F.sum(F.col("length") * F.col("height")).alias("area"))
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return area.join(n, list(keys), "left").select(*keys, F.coalesce("_n", F.lit(0)).alias("n"), "area", F.try_divide(F.coalesce("_n", F.lit(0)), "area").alias("rate"))


def merge_close(df: DataFrame, keys: tuple[str, ...], value: str, strength: str, apart: float = 0.06) -> DataFrame:
    """(keys, value, strength): sorted values merged where one is less than `apart` above the kept one, which a stronger one replaces.

    Of equal values only the strongest can stay, and a value `apart` or more above the one before it
    begins anew, whatever was kept. So a key's values are divided into stretches without such a gap,
    which are dealt to tasks, sorted, and read through with one kept row in memory. Rows without a value go; a null strength is the least.
    """
    import pandas as pd

    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias(value)).agg(F.coalesce(F.max(F.col(strength).cast("double")), F.lit(float("-inf"))).alias(strength))
    w = Window.partitionBy(*keys).orderBy(value)
    before = F.lag(value).over(w)
    rows = rows.withColumn("_new", (before.isNull() | (F.col(value) - before >= apart)).cast("long"))
    rows = rows.withColumn("_stretch", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ordered = rows.repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", value).select(*keys, value, strength, "_new")

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            both = batch if held is None else pd.concat([held, batch], ignore_index=True)
            at, v, s, new = -1, both[value].to_numpy(), both[strength].to_numpy(), both["_new"].to_numpy()
            done = []
            for k in range(len(both)):
                if at < 0 or new[k] or v[k] - v[at] >= apart:
                    if at >= 0:
                        done.append(at)
                    at = k
                elif s[k] > s[at]:
                    at = k
            if at >= 0:
                held = both.iloc[[at]]
                yield both.iloc[done]
        if held is not None:
            yield held

    return ordered.mapInPandas(kept, ordered.schema).select(*keys, value, F.when(F.col(strength) > float("-inf"), F.col(strength)).alias(strength))


def halves(df: DataFrame, keys: tuple[str, ...], order: list[str]) -> DataFrame:
    """Adds `half`: 0 for the first n // 2 rows of a key, 1 for the others."""
    w = Window.partitionBy(*keys)
    return df.withColumn("half", F.when(F.row_number().over(w.orderBy(*order)) <= F.floor(F.count(F.lit(1)).over(w) / 2), 0).otherwise(1))


def spread_along(walked: DataFrame, keys: tuple[str, ...], path: str, order: list[str], n: int) -> DataFrame:
    """Rows nearest to `n` evenly spaced targets along their key's path, each once; the first of equals. Targets meet the rows on either side by one sorted window."""
    ends = walked.groupBy(*keys).agg(F.min(path).alias("_lo"), F.max(path).alias("_hi"))
    goals = ends.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_k") / max(1, n - 1)).alias("_p"), "_k")
    rows = walked.select(*keys, F.col(path).alias("_p"), F.struct(F.col(path).alias("p"), *order).alias("_row"), F.lit(None).cast("int").alias("_k"))
    both = rows.unionByName(goals.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    back = Window.partitionBy(*keys).orderBy("_p", F.col("_k").isNotNull(), "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_p"), F.col("_k").isNotNull(), F.desc("_row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_a", F.last("_row", ignorenulls=True).over(back)).withColumn("_b", F.last("_row", ignorenulls=True).over(ahead)).where("_k is not null")
    lower = F.col("_b").isNull() | (F.col("_a").isNotNull() & (F.col("_p") - F.col("_a.p") <= F.col("_b.p") - F.col("_p")))
    return met.select(*keys, F.when(lower, F.col("_a")).otherwise(F.col("_b")).alias("_m")).select(*keys, "_m.*").distinct()
