"""Rooms put together to one plan: poses chained along links, and rooms attached at doors that fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measure import link_sigma, se2_compose, se2_invert, snap90
from ..operators.grids import cut

_TURNS = [(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)]


def link_edges(links: DataFrame, rooms: DataFrame, key: str) -> DataFrame:
    """(key, a, b, yaw, tx, tz, inliers, sigma): the link with most inliers of each two rooms that exist; the first of equals by `link`. Yaw is snapped to quarter turns."""
    names = rooms.select(key, "room").distinct()
    known = links.join(names.withColumnRenamed("room", "a"), [key, "a"], "left_semi").join(names.withColumnRenamed("room", "b"), [key, "b"], "left_semi").where("a <> b")
    best = known.groupBy(key, F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")).agg(F.max_by(F.struct("a", "b", "yaw", "tx", "tz", "inliers"), F.struct("inliers", -F.col("link"))).alias("m"))
    return best.select(key, "m.a", "m.b", snap90(F.col("m.yaw")).alias("yaw"), "m.tx", "m.tz", "m.inliers", link_sigma(F.greatest(F.col("m.inliers"), F.lit(1))).alias("sigma"))


def chained_poses(forest: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, room, root, yaw, tx, tz, sigma, hops): poses along the tree edges (key, a, b, yaw, tx, tz, sigma: b as a has it) from each root; against an edge its inverse. One hop of all trees a round."""
    iy, ix, iz = se2_invert(F.col("yaw"), F.col("tx"), F.col("tz"))
    steps = forest.select(key, F.col("a").alias("_from"), F.col("b").alias("_to"), *[F.col(c).alias(f"_{c}") for c in ("yaw", "tx", "tz", "sigma")])
    back = forest.select(key, F.col("b").alias("_from"), F.col("a").alias("_to"), iy.alias("_yaw"), ix.alias("_tx"), iz.alias("_tz"), F.col("sigma").alias("_sigma"))
    steps = cut(steps.unionByName(back))
    zero = F.lit(0.0)
    known = front = cut(roots.select(key, "room", F.col("room").alias("root"), zero.alias("yaw"), zero.alias("tx"), zero.alias("tz"), zero.alias("sigma"), F.lit(0).alias("hops")))
    while True:
        yaw, tx, tz = se2_compose(F.col("yaw"), F.col("tx"), F.col("tz"), F.col("_yaw"), F.col("_tx"), F.col("_tz"))
        more = front.withColumnRenamed("room", "_from").join(steps, [key, "_from"]).select(key, F.col("_to").alias("room"), "root", snap90(yaw).alias("yaw"), tx.alias("tx"), tz.alias("tz"), F.hypot("sigma", "_sigma").alias("sigma"), (F.col("hops") + 1).alias("hops"))
        front = cut(more.join(known.select(key, "room"), [key, "room"], "left_anti"))
        if not front.limit(1).count():
            return known
        known = cut(known.unionByName(front))


def _turn(x: Column, z: Column, turns: Column) -> tuple[Column, Column]:
    c, s = (F.element_at(F.array(*[F.lit(t[k]) for t in _TURNS]), turns + 1) for k in (0, 1))
    return c * x - s * z, s * x + c * z


def placed_boxes(boxes: DataFrame, poses: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Boxes (keys, x0, z0, x1, z1) moved by the pose (keys, turns, tx, tz) of their room."""
    rows = boxes.join(poses, list(keys))
    ax, az = _turn(F.col("x0"), F.col("z0"), F.col("turns"))
    bx, bz = _turn(F.col("x1"), F.col("z1"), F.col("turns"))
    tx, tz = F.col("tx"), F.col("tz")
    return rows.select(*keys, (F.least(ax, bx) + tx).alias("x0"), (F.least(az, bz) + tz).alias("z0"), (F.greatest(ax, bx) + tx).alias("x1"), (F.greatest(az, bz) + tz).alias("z1"), *[c for c in rows.columns if c not in (*keys, "x0", "z0", "x1", "z1", "turns", "tx", "tz")])


def overlaps(boxes: DataFrame, key: str, slack: float = 0.0, cell: float = 4.0) -> DataFrame:
    """(key, a, b, area): pairs of rooms of one plan whose boxes overlap by more than `slack` both ways, with the common area; boxes of one room must not overlap.

    Boxes meet in cells of both axes, and a pair of boxes is taken in the first cell that they share. Rooms of one box each are a pair once, which
    does not move any more; only pairs with a room of several boxes are brought together and summed up.
    """
    many = boxes.groupBy(key, "room").agg((F.count(F.lit(1)) > 1).alias("_many"))
    rows = boxes.join(many, [key, "room"])
    for c in "xz":
        rows = rows.withColumn(f"_{c}", F.explode(F.sequence(F.floor(F.col(f"{c}0") / cell), F.floor(F.col(f"{c}1") / cell))))
    dealt = lambda df: df.repartition(256, key, "_x", "_z")  # noqa: E731  # few bytes make many pairs
    side = lambda s, some: dealt(rows.where(some).select(key, "_x", "_z", *[F.col(c).alias(f"{c}_{s}") for c in ("room", "x0", "z0", "x1", "z1")]))
    w, h = (F.least(f"{c}1_a", f"{c}1_b") - F.greatest(f"{c}0_a", f"{c}0_b") for c in "xz")
    first = (F.floor(F.greatest("x0_a", "x0_b") / cell) == F.col("_x")) & (F.floor(F.greatest("z0_a", "z0_b") / cell) == F.col("_z"))

    def met(one: str, two: str) -> DataFrame:
        found = side("a", one).join(side("b", two).hint("merge"), [key, "_x", "_z"]).where("room_a < room_b").where((w > slack) & (h > slack) & first)
        return found.select(key, F.col("room_a").alias("a"), F.col("room_b").alias("b"), (w * h).alias("area"))

    if many.where("_many").isEmpty():
        return met("true", "true")
    summed = met("_many", "true").unionByName(met("not _many", "_many")).groupBy(key, "a", "b").agg(F.sum("area").alias("area"))
    return met("not _many", "not _many").unionByName(summed)


def attach_rooms(boxes: DataFrame, doors: DataFrame, key: str, *, wall: float = 0.15, width: float = 0.35, facing: float = -0.6, slack: float = 0.04) -> DataFrame:
    """(key, room, turns, tx, tz, score): a place for every room that doors attach to the root, the room with most doors (the first of equals).

    `boxes` (key, room, x0, z0, x1, z1) make up each room, `doors` (key, room, door, x, z, nx, nz, width) have
    the wall's inward normal. In each round every plan takes its best pending door: turned by a quarter so that
    both normals face each other, a wall's thickness behind the placed one, with the least difference of widths, and without an
    overlap with placed rooms. Rooms that nothing attaches have a null pose.
    """
    most = doors.groupBy(key, "room").agg(F.count(F.lit(1)).alias("_n"))
    every = boxes.select(key, "room").distinct().join(most, [key, "room"], "left")
    root = every.groupBy(key).agg(F.min(F.struct(-F.coalesce("_n", F.lit(0)), "room")).alias("m")).select(key, F.col("m.room").alias("room"))
    placed = cut(root.select(key, "room", F.lit(0).alias("turns"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("tz"), F.lit(0.0).alias("score")))
    turned = F.explode(F.array(*[F.lit(k) for k in range(4)]))
    while True:
        nx, nz = _turn(F.col("nx"), F.col("nz"), F.col("turns"))
        x, z = _turn(F.col("x"), F.col("z"), F.col("turns"))
        there = doors.join(placed, [key, "room"]).select(key, F.concat_ws("/", "room", "door").alias("to"), (x + F.col("tx")).alias("_x"), (z + F.col("tz")).alias("_z"), nx.alias("_nx"), nz.alias("_nz"), F.col("width").alias("_w"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("width") / width) + k)).alias("_cell"))
        pending = doors.join(placed.select(key, "room"), [key, "room"], "left_anti").withColumn("turns", turned)
        pending = pending.select(key, "room", "door", "turns", x.alias("px"), z.alias("pz"), nx.alias("pnx"), nz.alias("pnz"), "width", F.floor(F.col("width") / width).alias("_cell"))
        met = pending.join(there, [key, "_cell"]).withColumn("score", F.round(F.abs(F.col("width") - F.col("_w")), 9))
        met = met.where((F.col("score") <= width) & (F.col("pnx") * F.col("_nx") + F.col("pnz") * F.col("_nz") <= facing))
        trial = cut(met.select(key, "room", "door", "to", "turns", "score", (F.col("_x") - F.col("_nx") * wall - F.col("px")).alias("tx"), (F.col("_z") - F.col("_nz") * wall - F.col("pz")).alias("tz")))
        if not trial.limit(1).count():
            break
        names = (key, "room", "door", "to", "turns")
        own = placed_boxes(boxes.join(trial.select(*names).distinct().withColumn("_t", F.col("turns")), [key, "room"]).drop("turns"), trial.withColumn("_t", F.col("turns")), (key, "room", "door", "to", "_t"))
        fixed = placed_boxes(boxes, placed.drop("score"), (key, "room")).select(key, *[F.col(c).alias(f"f_{c}") for c in ("x0", "z0", "x1", "z1")])
        w, h = (F.least(f"{c}1", f"f_{c}1") - F.greatest(f"{c}0", f"f_{c}0") for c in "xz")
        bad = own.join(fixed, key).where((w > slack) & (h > slack)).select(key, "room", "door", "to", F.col("_t").alias("turns")).distinct()
        good = trial.join(bad, list(names), "left_anti")
        best = good.groupBy(key).agg(F.min(F.struct("score", "turns", "room", "door", "to", "tx", "tz")).alias("m"))
        fresh = cut(best.select(key, "m.room", "m.turns", "m.tx", "m.tz", "m.score"))
        if not fresh.limit(1).count():
            break
        placed = cut(placed.unionByName(fresh))
    return every.select(key, "room").join(placed, [key, "room"], "left")
