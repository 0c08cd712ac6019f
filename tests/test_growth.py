"""Rows that steps make on copies in one place: as many as the input, not as its pairs; results as from all pairs."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import contours as N
from plumbline.operators import geometry as X
from plumbline.operators import grids as G
from plumbline.operators import histograms as H
from plumbline.operators import joins as J
from plumbline.operators import openings as O
from plumbline.operators import overlay as V
from plumbline.operators import quantiles as Q
from plumbline.operators import rasters as T
from plumbline.operators import selection as K
from plumbline.plans import placement as L
from plumbline.plans import rooms as R
from plumbline.queries import QUERIES


def rows_made(spark, run, metric: str = "number of output rows") -> tuple[int, list]:
    """The rows (or another metric) of the plan node that made most of them, of all queries that `run` runs, and the rows of its result."""
    sc = spark.sparkContext._jsc.sc()
    store = spark._jsparkSession.sharedState().statusStore()
    sc.listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    rows = run().collect()
    sc.listenerBus().waitUntilEmpty()
    most = 0
    runs = store.executionsList()
    for at in range(before, runs.size()):
        done = runs.apply(at)
        values = store.executionMetrics(done.executionId())
        metrics = done.metrics()
        for k in range(metrics.size()):
            m = metrics.apply(k)
            if m.name() == metric and values.contains(m.accumulatorId()):
                most = max(most, int(re.sub(r"\D", "", values.apply(m.accumulatorId())) or 0))
    return most, rows


def test_nearest_within_meets_few_targets(spark):
    points = spark.range(3000).select("id", (F.col("id") * 37 % 1000 / 1000).alias("x"), (F.col("id") * 91 % 997 / 997).alias("z"), (F.col("id") % 3).alias("own"))
    targets = points.select((F.col("x") + 0.0003).alias("tx"), (F.col("z") * 0.99).alias("tz"), (F.col("own") + 1).alias("other"))
    most, rows = rows_made(spark, lambda: O.nearest_within(points, "id", ("x", "z"), targets, ("tx", "tz"), 2.0, apart=("own", "other")))
    d = F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("z") - F.col("tz")) ** 2)
    truth = points.crossJoin(targets).where("own <> other").groupBy("id").agg(F.min(d).alias("d"))
    assert {r.id: round(r.dist, 12) for r in rows} == {r.id: round(r.d, 12) for r in truth.collect()}
    assert most < 200_000  # 9 million pairs are within reach


def test_nearest_plane_meets_planes_of_one_place_once(spark):
    points = spark.range(2000).select("id", (F.col("id") % 20 + 0.01).alias("x"), F.lit(500.0).alias("z"))
    planes = spark.range(3000).select((3000 - F.col("id")).alias("surface"), F.lit(0).alias("axis"), (F.col("id") % 20).cast("double").alias("c"))
    most, rows = rows_made(spark, lambda: O.nearest_plane(points, "id", planes))
    assert most <= 9000  # three cells of each plane; 300,000 pairs
    assert {r.id: r.surface for r in rows} == {i: min(3000 - k for k in range(3000) if k % 20 == i % 20) for i in range(2000)}


def test_wall_density_counts_a_place_once(spark):
    points = spark.range(2000).select(F.lit(1.01).alias("x"), (F.col("id") % 50 / 10).alias("z"), F.lit(1.0).alias("h"))
    walls = spark.range(500).select(F.col("id").alias("wall_id"), F.lit(0).alias("axis"), F.lit(1.0).alias("c"), (F.col("id") % 2).cast("double").alias("t0"), F.lit(4.0).alias("t1"), F.lit(1.0).alias("coverage"))
    most, rows = rows_made(spark, lambda: O.wall_density(points, walls))
    n = {s: sum(40 for k in range(50) if s + 0.1 < k / 10 < 3.9) for s in (0, 1)}
    assert {r.wall_id: round(r.density, 6) for r in rows} == {w: round(n[w % 2] / ((3.8 - w % 2) * 1.9), 6) for w in range(500)}
    assert most <= 12_000  # 600,000 pairs


def test_gap_totals_are_those_of_the_pairs(spark):
    gaps = spark.range(900).select(F.col("id").alias("gap_id"), (F.col("id") % 2).cast("int").alias("axis"), (F.col("id") % 7 / 4).alias("c"), (F.col("id") % 5 / 2).alias("a"), (F.col("id") % 5 / 2 + F.col("id") % 3 / 2 + 0.4).alias("b"))
    walls = spark.range(200).select(F.col("id").alias("wall_id"), (F.col("id") % 2).cast("int").alias("axis"), (F.col("id") % 10 / 5 + 0.03).alias("c"), (F.col("id") % 4 / 3).alias("t0"), (F.col("id") % 4 / 3 + 1.2).alias("t1"))
    most, rows = rows_made(spark, lambda: O.gap_totals(gaps, walls))
    pairs = O.gaps_on_walls(gaps, walls).groupBy("wall_id").agg(F.count(F.lit(1)).alias("n"), F.sum("overlap").alias("overlap")).collect()
    assert {r.wall_id: (r.n, round(r.overlap, 9)) for r in rows} == {r.wall_id: (r.n, round(r.overlap, 9)) for r in pairs}
    assert most < sum(r.n for r in pairs)


def test_counts_in_boxes_are_those_of_the_pairs(spark):
    points = spark.range(3000).select((F.col("id") % 30 / 3).alias("x"), (F.col("id") % 10).cast("double").alias("z"))
    boxes = spark.range(600).select("id", (F.col("id") % 12 / 2 - 1).alias("xmin"), (F.col("id") % 12 / 2 + 1).alias("xmax"), (F.col("id") % 3).alias("zmin"), (F.col("id") % 3 + 4).alias("zmax"))
    most, rows = rows_made(spark, lambda: K.counts_in_boxes(points, boxes, "id", "x", "z", 2.0))
    pairs = K.in_boxes(points, boxes, "x", "z", 2.0).groupBy("id").count().collect()
    assert {r.id: r.n for r in rows} == {r.id: r["count"] for r in pairs}
    assert most <= 3000 < sum(r["count"] for r in pairs)


def test_counts_in_boxes_make_no_row_for_a_pair_of_different_places(spark):
    points = spark.range(4000).select(F.when(F.col("id") % 5 == 0, 3.0).otherwise(F.col("id") * 7919 % 4001 / 400).alias("x"), (F.col("id") * 104729 % 3989 / 400).alias("z"))  # a fifth of them in one line
    points = points.unionByName(points.limit(1)).unionByName(spark.createDataFrame([(None, 1.0), (1.0, None)], "x double, z double"))
    boxes = spark.range(400).select("id", (F.col("id") % 97 / 10 - 1).alias("xmin"), (F.col("id") % 97 / 10 + F.col("id") % 7 - 1).alias("xmax"), (F.col("id") % 9).alias("zmin"), (F.col("id") % 9 + F.col("id") % 4).alias("zmax"))
    pairs = K.in_boxes(points, boxes, "x", "z", 2.0).groupBy("id").count().collect()
    for size in (300, 500_000):
        most, rows = rows_made(spark, lambda size=size: K.counts_in_boxes(points, boxes, "id", "x", "z", 2.0, size))
        assert {r.id: r.n for r in rows} == {r.id: r["count"] for r in pairs}
        assert most < 8000 < sum(r["count"] for r in pairs) / 7


def test_door_pairs_take_a_width_and_side_once(spark):
    doors = spark.range(1200).select((F.col("id") % 3).alias("room"), F.col("id").alias("door"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0).alias("nx"), F.lit(0.0).alias("nz"), (F.col("id") % 5 / 10).alias("width"))
    most, rows = rows_made(spark, lambda: K.door_pairs(doors))
    assert {(r.room_a, r.room_b): (r.door_a, r.door_b, r.turns, r.diff) for r in rows} == {(0, 1): (0, 25, 0, 0.0), (0, 2): (0, 5, 0, 0.0), (1, 2): (1, 26, 0, 0.0)}
    assert most < 5000  # 480,000 pairs


def test_door_pairs_of_different_widths_meet_their_neighbours(spark):
    rng = random.Random(5)
    normals = [(1.0, 0.0), (0.0, 1.0), (0.6, -0.8), (0.0, 0.0), (0.7, 0.0)]  # of the last two one faces nothing, one not all
    rows = [(k % 4, k, *normals[k % 3], rng.random()) for k in range(1600)]
    rows += [(4, 1600 + k, *normals[3 + k % 2], rng.random()) for k in range(40)] + [(5, 1700 + k, *normals[4], 0.3 + k * 1e-17) for k in range(9)]
    rows += [(6, 1802, 1.0, 0.0, 0.1 + 0.2), (6, 1801, 1.0, 0.0, 0.3), (7, 1803, 0.0, 1.0, 0.3), (7, 1804, None, 1.0, 0.3), (8, 1805, 1.0, 0.0, None), (9, 1806, 1.0, 0.0, 9.0), (9, 1807, 1.0, 0.0, float("nan"))]
    doors = spark.createDataFrame(rows, "room int, door long, nx double, nz double, width double")
    most, found = rows_made(spark, lambda: K.door_pairs(doors))
    truth: dict = {}
    for room, door, nx, nz, width in rows:
        for other, second, mx, mz, wide in rows:
            if room < other and None not in (nx, width, mx, wide) and (diff := round(abs(width - wide), 9)) <= 0.35:
                for turns, (c, s) in enumerate([(1, 0), (0, 1), (-1, 0), (0, -1)]):
                    if nx * (mx * c - mz * s) + nz * (mx * s + mz * c) <= -0.6:
                        truth[room, other] = min(truth.get((room, other), (9.0,)), (diff, turns, door, second))
    assert {(r.room_a, r.room_b): (r.diff, r.turns, r.door_a, r.door_b) for r in found} == truth
    assert truth[6, 7] == (0.0, 1, 1801, 1803) and len(truth) > 15
    assert most < 40_000  # about 600,000 pairs within 35 cm


def test_overlapping_boxes_are_paired_without_moving_the_pairs(spark):
    rng = random.Random(3)
    made = [(k % 2, k, x := rng.random() * 6, z := rng.random() * 6, x + 1 + rng.random() * 3, z + 1 + rng.random() * 3) for k in range(300)]
    form = "plan int, room int, x0 double, z0 double, x1 double, z1 double"

    def truth(rows) -> dict:
        areas: dict = {}
        for p, a, ax, az, bx, bz in rows:
            for q, b, cx, cz, dx, dz in rows:
                w, h = min(bx, dx) - max(ax, cx), min(bz, dz) - max(az, cz)
                if p == q and a < b and w > 0.5 and h > 0.5:
                    areas[p, a, b] = areas.get((p, a, b), 0) + w * h
        return {k: round(v, 9) for k, v in areas.items()}

    most, rows = rows_made(spark, lambda: L.overlaps(spark.createDataFrame(made, form), "plan", 0.5), "shuffle records written")
    assert {(r.plan, r.a, r.b): round(r.area, 9) for r in rows} == truth(made) and len(rows) == len(truth(made))
    assert most < 2000 < len(rows)
    made += [(k % 2, k, x + 20, z, x + 22, z + 2) for k in range(0, 300, 3) for x, z in [(rng.random() * 9, rng.random() * 9)]]  # a second box of some rooms
    rows = L.overlaps(spark.createDataFrame(made, form), "plan", 0.5).collect()
    assert {(r.plan, r.a, r.b): round(r.area, 9) for r in rows} == truth(made) and len(rows) == len(truth(made))


def test_spots_in_and_near_polygons_are_those_of_the_tests_of_all_edges(spark):
    ring = spark.range(120).select((F.col("id") % 4).alias("k"), "id", (F.col("id") * 7919 % 101 / 5).alias("x"), (F.col("id") * 104729 % 103 / 5).alias("z"))
    edges = X.edges(ring, ("k",), "id")
    points = spark.range(400).select("id", (F.col("id") % 20 + 0.17).alias("x"), (F.floor(F.col("id") / 20) + 0.13).alias("z"))
    pairs = points.crossJoin(edges).withColumns({"up": (F.col("z1") > F.col("z")) != (F.col("z2") > F.col("z")), "at": (F.col("x2") - F.col("x1")) * (F.col("z") - F.col("z1")) / F.nullif(F.col("z2") - F.col("z1"), F.lit(0.0)) + F.col("x1")})
    inside = pairs.where("up and x < at").groupBy("id", "k").count().where("count % 2 = 1")
    dx, dz = F.col("x2") - F.col("x1"), F.col("z2") - F.col("z1")
    t = F.least(F.greatest(((F.col("x") - F.col("x1")) * dx + (F.col("z") - F.col("z1")) * dz) / F.greatest(dx * dx + dz * dz, F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))
    near = pairs.where((F.col("x") - F.col("x1") - t * dx) ** 2 + (F.col("z") - F.col("z1") - t * dz) ** 2 <= 0.25).select("id", "k").distinct()
    got = lambda df: sorted((r.id, r.k) for r in df.collect())
    assert got(X.spots_in_polygons(points, edges, ("k",), "id", "x", "z", 3.0)) == got(inside)
    most, rows = rows_made(spark, lambda: K.near_edges(points, "id", "x", "z", edges, ("k",), 0.5, 2.0))
    assert sorted((r.id, r.k) for r in rows) == got(near)


def test_places_inside_polygons_do_not_move_with_their_parts(spark, small_dir):
    off = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in off:
        spark.conf.set(k, "-1")  # as for tables that are not small
    try:
        most, rows = rows_made(spark, lambda: QUERIES["points_in_polygons"](spark, small_dir), "shuffle records written")
    finally:
        for k, v in off.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 355 and most <= 1000  # the events; heights of edges are 24 times as many


def test_hulls_of_many_keys_go_through_python_together(spark):
    points = spark.range(9000).select(F.when(F.col("id") % 1500 > 0, F.col("id") % 1500).alias("k"), (F.col("id") * 7919 % 13 / 4).alias("x"), (F.col("id") * 104729 % 17 / 4).alias("z"))
    empty = spark.createDataFrame([(1, None, 1.0), (1, 9.0, None), (2000, None, None)], "k long, x double, z double")  # points with a null are none
    found = X.hulls(points.unionByName(empty), ("k",), "x", "z")
    rings: dict = {}
    for r in points.collect():
        rings.setdefault(r.k, []).append((r.x, r.z))
    assert {(r.k, r.corner): (r.x, r.z) for r in found.collect()} == {(k, n): p for k, v in rings.items() for n, p in enumerate(X.chain(v))}
    assert None in rings and "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()  # some milliseconds for each key and part


def test_levels_of_small_keys_are_those_of_the_rounds(spark, monkeypatch):
    values = spark.range(4000).select(F.when(F.col("id") % 90 > 0, F.col("id") % 90).alias("k"), ((F.col("id") * 7919 % 211 - 105) / 700 + F.when(F.col("id") % 11 == 0, 0.2).otherwise(0.0)).alias("v"), F.lit(0.01).alias("g"))
    values = values.unionByName(spark.createDataFrame([(500, 0.02, 0.01), (500, None, 0.01), (501, 9.0, 0.01)], "k long, v double, g double"))
    told = lambda: {r.k: (round(r.level, 10), round(r.sd, 10), r.n) for r in H.robust_level(values, "v", "g", 0.3, keys=("k",)).collect()}
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsCount()
    held = told()
    runs = store.executionsCount() - runs
    monkeypatch.setattr(H, "HELD", 0)
    assert held == told() and len(held) == 90 and held[500] == (0.01, 0.3, 1)
    assert runs <= 3  # written, counted and read; each round was some more


def test_nearest_vectors_are_those_of_all_distances(spark):
    v = spark.range(900).select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda d: ((F.col("id") % 300 * (d + 3)) % 17 / 5).cast("float")).alias("v"))
    most, rows = rows_made(spark, lambda: J.nearest_vectors(v.where("id % 10 = 0"), v, "id", "v", 3, block=100))
    pairs = v.where("id % 10 = 0").select(F.col("id").alias("q"), F.col("v").alias("a")).crossJoin(v.select(F.col("id").alias("other"), F.col("v").alias("b"))).where("q <> other")
    truth: dict = {}
    for r in pairs.select("q", "other", F.round(J.squared_distance(F.col("a"), F.col("b")), 9).alias("d2")).collect():
        truth.setdefault(r.q, []).append((r.d2, r.other))
    assert {(r.id, r.rank): (r.d2, r.other) for r in rows} == {(q, k + 1): d for q, found in truth.items() for k, d in enumerate(sorted(found)[:3])}
    assert most < 40_000  # 81,000 pairs


def test_nearest_vectors_pass_over_vectors_with_nulls(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, None), (2, [1.0, None]), (3, [3.0, 4.0]), (4, [1.0])], "id long, v array<float>")
    assert [(r.id, r.rank, r.other, r.d2) for r in J.nearest_vectors(v.where("id = 0"), v, "id", "v", 3).collect()] == [(0, 1, 3, 25.0)]


def test_rooms_in_a_row_meet_their_own_edges(spark):
    rooms = spark.range(60).select(F.lit(0).alias("capture"), F.col("id").alias("room"), (F.col("id") * 12.0).alias("x0"))
    corners = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("dx"), F.lit(z).alias("z")) for k, (x, z) in enumerate([(0.0, 0.0), (5.0, 0.0), (5.0, 3.0), (0.0, 3.0)])])
    edges = X.edges(rooms.withColumn("s", F.explode(corners)).select("capture", "room", "s.k", (F.col("x0") + F.col("s.dx")).alias("x"), F.col("s.z").alias("z")), ("capture", "room"), "k")
    points = spark.range(1800).select(F.lit(0).alias("capture"), "id", (F.col("id") % 360 * 2 + 0.3).alias("x"), (F.floor(F.col("id") / 360) * 0.6 + 0.2).alias("z"))
    most, rows = rows_made(spark, lambda: X.points_in_polygons(points, edges, ("capture", "room"), "id", "x", "z", 0.5, ("capture",)))
    assert {(r.id, r.room) for r in rows} == {(i, i % 360 * 2 // 12) for i in range(1800) if i % 360 * 2 % 12 + 0.3 < 5}
    assert most < 6000  # 60 right edges are beside each point of the first rooms


def test_wall_points_meet_the_edges_along_them(spark):
    sides = spark.range(60).select(F.lit(0).alias("capture"), F.col("id").alias("edge"), F.lit(1).alias("axis"), F.lit(3.0).alias("c"), (F.col("id") * 12.0).alias("lo"), (F.col("id") * 12.0 + 5).alias("hi"), F.lit(1).alias("out"))
    points = spark.range(3000).select(F.lit(0).alias("capture"), (F.col("id") % 60 * 12.0 + F.floor(F.col("id") / 60) / 10 + 0.01).alias("x"), F.lit(3.02).alias("z"), F.lit(0.0).alias("nx"), F.lit(-1.0).alias("nz"), F.lit(1.0).alias("h"), F.lit(1.0).alias("w"))
    p, e = R.along_edges(points, sides, ("capture",), 0.5)
    most, rows = rows_made(spark, lambda: p.join(e, ["capture", "axis", "_cell", "_along"]))
    assert most <= 6000  # 180,000 by line alone
    found = {r.edge: (round(r.c, 6), r.n) for r in R.refined_edges(points, sides, within=("capture",)).collect()}
    assert found == {k: (3.02, 49) for k in range(60)}  # 0.11 to 4.91 along, 8 cm off both ends


def test_rays_meet_gaps_in_the_cell_of_the_crossing(spark):
    rays = spark.range(400).select(F.col("id").alias("ray"), (F.col("id") * 37 % 101 / 40 - 1).alias("cx"), F.lit(0.5).alias("cy"), (F.col("id") * 53 % 97 / 20 - 2.5).alias("cz"), (F.col("id") * 71 % 89 / 40 - 1).alias("px"), F.lit(1.0).alias("py"), (F.col("id") * 29 % 83 / 20 - 2).alias("pz"))
    upright = rays.select((F.col("ray") + 400).alias("ray"), "cx", "cy", "cz", F.col("cx").alias("px"), "py", "pz")  # along a column of cells
    rays = rays.unionByName(upright)
    gaps = spark.range(200).select(F.col("id").alias("gap_id"), (F.col("id") % 20 / 8 - 1.25).alias("gx"), (F.col("id") % 9 / 4 - 1).alias("gz"), F.when(F.col("id") % 3 == 0, 0.6).otherwise(0.0).alias("nx"), F.when(F.col("id") % 3 == 0, 0.8).otherwise(1.0).alias("nz"), (F.col("id") % 5 / 2 + 1).alias("width"), F.lit(-1.0).alias("floor_y"))
    most, rows = rows_made(spark, lambda: O.rays_through(rays, gaps))
    truth = set()
    for r in rays.collect():
        for g in gaps.collect():
            sp, sc = -((r.px - g.gx) * g.nx + (r.pz - g.gz) * g.nz), -((r.cx - g.gx) * g.nx + (r.cz - g.gz) * g.nz)
            if 0.1 < sp < 4 and sc < -0.05:
                t = sc / (sc - sp)
                along = -(r.cx + t * (r.px - r.cx) - g.gx) * g.nz + (r.cz + t * (r.pz - r.cz) - g.gz) * g.nx
                height = r.cy + t * (r.py - r.cy) - g.floor_y
                if abs(along) < g.width / 2 - 0.03 and 0.1 < height < 2:
                    truth.add((g.gap_id, r.ray, round(along, 9), round(height, 9)))
    assert {(r.gap_id, r.ray, round(r.along, 9), round(r.height, 9)) for r in rows} == truth and len(truth) == len(rows) > 1000
    assert most < 120_000  # of 160,000 pairs, each is made in few cells


def test_hits_of_rays_lie_by_gap_and_do_not_move(spark):
    rays = spark.range(4000).select(F.col("id").alias("ray"), (F.col("id") * 37 % 101 / 40 - 1).alias("cx"), F.lit(0.5).alias("cy"), (F.col("id") * 53 % 97 / 20 - 2.5).alias("cz"), (F.col("id") * 71 % 89 / 40 - 1).alias("px"), (F.col("id") % 11 / 10).alias("py"), (F.col("id") * 29 % 83 / 20 - 2).alias("pz"))
    gaps = spark.range(100).select(F.col("id").alias("gap_id"), (F.col("id") % 20 / 8 - 1.25).alias("gx"), (F.col("id") % 9 / 4 - 1).alias("gz"), F.lit(0.0).alias("nx"), F.when(F.col("id") % 3 == 0, -1.0).otherwise(1.0).alias("nz"), (F.col("id") % 5 / 2 + 1).alias("width"), F.lit(-1.0).alias("floor_y"))
    hits: dict = {}
    for r in O.rays_through(rays, gaps).collect():
        hits.setdefault(r.gap_id, []).append(r.height)
    most, rows = rows_made(spark, lambda: O.through_ratio(O.rays_through(rays, gaps), gaps, F.lit(2.0)), "shuffle records written")
    assert len(rows) == 100 and max(len(h) for h in hits.values()) >= 50 > min(len(h) for h in hits.values())
    for r in rows:
        h = hits.get(r.gap_id, [])
        assert r.hits == len(h)
        assert (r.low, r.high) == (None, None) if len(h) < 50 else np.allclose([r.low, r.high], np.percentile(h, [3, 97]), atol=1e-12)
    assert most <= 100 < sum(len(h) for h in hits.values()) / 100  # a gap is one row


def test_overlap_of_convex_rings_is_that_of_the_sweep(spark):
    rng = random.Random(5)
    turns = [(0.2 * math.cos(math.pi * k / 4), 0.2 * math.sin(math.pi * k / 4)) for k in range(8)]
    wide = lambda points: X.chain((x + dx, z + dz) for x, z in points for dx, dz in turns)
    spot = lambda: (rng.randint(0, 8) / 5, rng.randint(0, 8) / 5)
    pairs = [([spot() for _ in range(rng.randint(1, 3))], [spot() for _ in range(rng.randint(1, 3))]) for _ in range(150)]
    pairs = [(wide(a), wide(b if k % 3 else [*b, a[0]])) for k, (a, b) in enumerate(pairs)]  # every third shares a corner, so edges lie on each other
    pairs += [([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], b) for b in ([(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(0.5, 0.0), (1.0, 0.0), (1.0, 0.5), (0.5, 0.5)], [(0.25, 0.25), (0.5, 0.25), (0.5, 0.5)])]
    edges = lambda side: spark.createDataFrame([(k, *r[i], *r[(i + 1) % len(r)]) for k, p in enumerate(pairs) for r in [p[side]] for i in range(len(r))], "k int, x1 double, z1 double, x2 double, z2 double")
    truth = {r.k: r.common / r.joint for r in V.overlay(edges(0), edges(1), ("k",)).collect()}
    got = V.convex_iou(*[pd.Series([np.array([c[i] for c in p[side]]) for p in pairs]) for side in (0, 1) for i in (0, 1)])
    assert max(abs(got[k] - truth[k]) for k in range(len(pairs))) < 1e-9


def test_view_consistency_hands_few_rows_to_python(spark):
    views = spark.range(6000).select((F.col("id") % 300).alias("c"), F.floor(F.col("id") / 1500).alias("view"), (F.col("id") % 7 / 4).alias("u"), (F.col("id") % 5 / 4).alias("v"))
    most, rows = rows_made(spark, lambda: V.view_consistency(views, ("c",), "view", "u", "v", pad=0.2, directions=8))
    assert len(rows) == 300 and {r.n_views for r in rows} == {4}
    assert most <= 6000  # the sweep makes a row for each strip and edge


def test_near_values_make_the_pairs_of_the_result_only(spark):
    rows = spark.range(1200).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 40 / 10).alias("v"))
    other = rows.select("k", F.col("id").alias("other"), F.col("v").alias("w"))
    most, found = rows_made(spark, lambda: J.near_join_of_values(rows, other, "v", "w", 0.25, ("k",)))
    truth = {(a, b) for a in range(1200) for b in range(a % 3, 1200, 3) if abs(a % 40 / 10 - b % 40 / 10) <= 0.25}
    assert {(r.id, r.other) for r in found} == truth and len(found) == len(truth)
    assert most <= len(truth)


def test_greedy_pairs_read_many_keys_at_once(spark):
    rows = spark.range(6000).select((F.col("id") % 500).alias("k"), (F.floor(F.col("id") / 500) % 4).alias("a"), (F.floor(F.col("id") / 2000)).alias("b"), (F.col("id") * 7919 % 101 / 10).alias("s"))
    for best_first in (True, False):
        df = J.greedy_pairs(rows, ("k",), "a", "b", "s", best_first=best_first)
        truth = []
        for k in range(500):
            used_a, used_b = set(), set()
            for r in sorted([(i // 500 % 4, i // 2000, i * 7919 % 101 / 10) for i in range(k, 6000, 500)], key=lambda r: (-r[2], r[0], r[1]) if best_first else (r[0], -r[2], r[1])):
                if r[0] not in used_a and r[1] not in used_b:
                    used_a.add(r[0])
                    used_b.add(r[1])
                    truth.append((k, *r))
        assert sorted(map(tuple, df.collect())) == sorted(truth)
        assert "FlatMapGroups" not in df._jdf.queryExecution().toString()  # a call for each key


def test_loop_closures_send_a_frame_to_few_cells(spark):
    frames = spark.range(1200).select((F.col("id") % 30).alias("u"), F.floor(F.col("id") / 30).alias("place"), (F.floor(F.col("id") / 30) % 8 * 2.0 - 3).alias("x"), (F.floor(F.col("id") / 30) % 5 * 2.0 - 3).alias("z"))
    most, rows = rows_made(spark, lambda: K.loop_closures(frames, "u", "place", ("x", "z"), F.lit(True), gap=3))
    def plain():
        for p in range(3, 40):
            near = sorted((round(math.dist((p % 8 * 2, p % 5 * 2), (o % 8 * 2, o % 5 * 2)), 9), o) for o in range(p - 2))
            late = [(round(math.dist((p % 8 * 2, p % 5 * 2), (o % 8 * 2, o % 5 * 2)), 9), o) for o in sorted({k * (p - 3) // 4 for k in range(5)})]
            both = [x for x in near if x[0] < 1.2] + [x for x in late if x[0] >= 1.2]
            yield from ((p, o, d) for d, o in both[:2])
    truth = set(plain())
    assert {(r.u, r.place, r.other, r.dist) for r in rows} == {(u, *t) for u in range(30) for t in truth}
    assert most <= 5600  # five spaced ones of 37 places; 9 cells a frame were 10,800


def test_percentiles_of_few_keys_move_no_rows(spark):
    df = spark.range(50_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 50_021 / 10).alias("v"))
    found = Q.exact_percentiles(df, ("k",), "v", [0.5, 0.9])
    rows = {r.k: r.p for r in found.collect()}
    assert rows == {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.9))).alias("p")).collect()}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rooms_of_one_shape_are_overlaid_once(spark):
    rooms = spark.range(300).select((F.col("id") % 3).alias("plan"), "id", (F.col("id") % 5 * 0.4).alias("x0"))
    spots = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("dx"), F.lit(z).alias("z")) for k, (x, z) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 2.0), (0.0, 2.0)])])
    corners = rooms.withColumn("s", F.explode(spots)).select("plan", "id", "s.k", (F.col("x0") + F.col("s.dx")).alias("x"), F.col("s.z").alias("z"))
    most, rows = rows_made(spark, lambda: N.overlapping(corners, "plan", "id", "k"))
    truth = {(a % 3, a, b): round(2 * (1 - 0.4 * abs(a % 5 - b % 5)), 6) for a in range(300) for b in range(a + 1, 300) if a % 3 == b % 3 and abs(a % 5 - b % 5) < 3}
    assert {(r.plan, r.a, r.b): round(r.common, 6) for r in rows} == truth and len(rows) == len(truth)
    assert most <= 3 * len(truth)  # no strips and edges for each pair


def _gap_by_gap(inner, visited, gaps, res, door=1.3, area=1.0, split=0.5, sliver=1.5):
    """One plan's rooms and closures with every gap decided by itself on the cells."""
    def line(x1, z1, x2, z2):
        n = max(2, math.ceil(math.hypot(x2 - x1, z2 - z1) / (res * 0.5)))
        spots = {(math.floor((x1 + (x2 - x1) * (k / (n - 1))) / res), math.floor((z1 + (z2 - z1) * (k / (n - 1))) / res)) for k in range(n)}
        return {(i + a, j + b) for i, j in spots for a in (-1, 0, 1) for b in (-1, 0, 1)}

    cross = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))
    order = sorted((w, g, line(*at)) for g, *at, w in gaps)
    over = {g: cells for _, g, cells in order}
    ring = {g: {(i + a + c, j + b + d) for i, j in cells for a, b in cross for c, d in cross} for g, cells in over.items()}

    def regions(shut):
        left, found = inner - set().union(*(over[g] for g in shut)), {}
        while left:
            first = min(left)
            frontier, group = [first], set()
            left.remove(first)
            while frontier:
                i, j = frontier.pop()
                group.add((i, j))
                near = {(i + a, j + b) for a, b in cross} & left
                left -= near
                frontier += near
            found[first] = group
        return found

    def around(g, found):
        return {k for k, group in found.items() if group & ring[g]}

    doors = [g for w, g, _ in order if w <= door]
    found = regions(doors)
    shut = {g: "door" for g in doors if len(around(g, found)) > 1}
    for w, g, _ in order:
        if w > door:
            found = regions({g, *shut})
            sides = around(g, found)
            if len(sides) > 1 and any(found[k] & visited for k in sides) and any(len(found[k]) * res * res > split for k in sides if not found[k] & visited):
                shut[g] = "window_or_glass"
    while True:
        found = regions(shut)
        clips = lambda g: len(around(g, found)) > 1 and any(found[k] & visited and len(found[k]) * res * res < sliver for k in around(g, found))  # noqa: E731, B023
        clipping = next((g for g in shut if shut[g] == "door" and clips(g)), None)
        if clipping is None:
            break
        del shut[clipping]
    rooms = [found[k] for k in sorted(found) if found[k] & visited and len(found[k]) * res * res >= area]
    return {(i, j, n) for n, group in enumerate(rooms, 1) for i, j in group}, shut


def test_gaps_of_one_line_are_decided_as_each_by_itself(spark):
    """Sixteen plans whose gaps repeat lines in mixed order and with other widths: rooms and closures as gap by gap."""
    rng, res = random.Random(7), 0.25
    plans = {}
    for k in range(16):
        inner = {(i, j) for i in range(16) for j in range(16) if rng.random() < 0.85}
        visited = {c for c in inner if rng.random() < (0.02 if k % 2 else 0.15)}
        lines = []
        for _ in range(14):
            x, z, long = rng.randrange(16) * res, rng.randrange(16) * res, rng.randrange(2, 9) * res
            lines.append((x, z, x, z + long) if rng.random() < 0.5 else (x, z, x + long, z))
        plans[f"p{k}"] = inner, visited, [(g, *rng.choice(lines), rng.choice((0.8, 1.2, 1.5, 2.0))) for g in range(45)]
    cells = lambda at: spark.createDataFrame([(p, *c) for p, v in plans.items() for c in sorted(v[at])], "capture string, i long, j long")
    gaps = spark.createDataFrame([(p, *g) for p, v in plans.items() for g in v[2]], "capture string, gap_id long, x1 double, z1 double, x2 double, z2 double, width double")
    rows = R.segment_rooms(cells(0), cells(1), gaps, res).collect()
    opened = kinds = 0
    for p, (inner, visited, given) in plans.items():
        room_cells, shut = _gap_by_gap(inner, visited, given, res)
        assert {(r.i, r.j, r.label) for r in rows if r.capture == p and r.what == "cell"} == room_cells
        assert {r.gap_id: r.kind for r in rows if r.capture == p and r.what == "closure"} == shut
        kinds += len(set(shut.values())) > 1
        opened += shut != _gap_by_gap(inner, visited, given, res, sliver=0.0)[1]
    assert kinds > 3 and opened > 3  # windows were shut and doors opened again in several plans


def test_copies_of_gaps_are_drawn_once(spark):
    inner = spark.range(61 * 20).select(F.lit("k").alias("capture"), F.floor(F.col("id") / 20).alias("i"), (F.col("id") % 20).alias("j")).where("i <> 30 or j between 6 and 14")
    visited = inner.where("i between 10 and 50 and j between 9 and 10")
    gaps = spark.range(3000).select(F.lit("k").alias("capture"), F.col("id").alias("gap_id"), F.lit(3.05).alias("x1"), F.lit(0.55).alias("z1"), F.lit(3.05).alias("x2"), F.lit(1.55).alias("z2"), F.lit(0.9).alias("width"))
    most, rows = rows_made(spark, lambda: R.segment_rooms(inner, visited, gaps, 0.1))
    assert {r.gap_id: r.kind for r in rows if r.what == "closure"} == {g: "door" for g in range(3000)}
    assert len({r.label for r in rows if r.what == "cell"}) == 2
    assert most < 20_000  # 3000 gaps have a hundred cells and more each


def test_rooms_in_a_row_meet_their_own_lines(spark):
    """300 rooms of 2.5 m in a row, all with walls on the same two lines along it; of close lines the one that is longer beside the room stays, copies counted, cells of a long one not."""
    k = spark.range(300).select(F.lit("p").alias("capture"), F.col("id").alias("room"), (F.col("id") * 4.0).alias("x0"))
    cells = k.crossJoin(spark.range(100)).select("capture", "room", (F.col("x0") * 4 + F.floor(F.col("id") / 10)).cast("long").alias("i"), (F.col("id") % 10).alias("j"))
    given = [(1, -0.01, 0.0, 2.5), (1, 2.51, 0.0, 2.5), (1, -0.03, 0.5, 1.8), (1, -0.03, 0.5, 1.8)]  # 2 * 1.3 are more than 2.5
    lines = k.select("capture", "x0", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(c).alias("c"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for a, c, lo, hi in given])).alias("e"))
    lines = lines.select("capture", "e.axis", "e.c", (F.col("x0") + F.col("e.lo")).alias("a"), (F.col("x0") + F.col("e.hi")).alias("b"))
    lines = lines.unionByName(spark.createDataFrame([("p", 1, 2.53, -1e4, 1203.0), ("q", 1, -0.04, 0.0, 2000.0)], lines.schema))
    most, rows = rows_made(spark, lambda: R.snapped_outline(cells, lines, 0.25, keys=("capture", "room"), within=("capture",)))
    got = {}
    for r in rows:
        got.setdefault(r.room, set()).add((r.x, r.z))
    assert got == {n: {(4.0 * n + x, z) for x in (0.0, 2.5) for z in (-0.03, 2.51)} for n in range(300)}
    assert most <= 70_000  # 14 for each of 16 rows of a room, closed; 360,000 pairs of rooms and lines


def test_squares_close_by_runs(spark):
    rng = random.Random(3)
    cells = spark.createDataFrame([(k, rng.randrange(-12, 12), rng.randrange(-40, 40) * (1 + k)) for k in range(3) for _ in range(250)], "room int, i int, j long")
    for times in (1, 3):
        stepped = cells
        for step in (G.dilate, G.erode):
            for _ in range(times):
                stepped = step(stepped, G.SQUARE, ("room",))
        got = G.closed(cells, times=times, keys=("room",))
        rows = [tuple(r) for r in got.collect()]
        assert got.dtypes == cells.dtypes and len(rows) == len(set(rows)) and set(rows) == {tuple(r) for r in stepped.collect()}


def test_holes_lie_between_runs(spark):
    rng = random.Random(4)
    own = {(k, i, j) for k in range(3) for i in range(14) for j in range(20) if rng.random() < 0.55 and i != 7 * (k == 1)}
    want = set()
    for k in range(3):
        at = {c[1:] for c in own if c[0] == k}
        i0, i1, j0, j1 = min(i for i, _ in at), max(i for i, _ in at), min(j for _, j in at), max(j for _, j in at)
        empty = {(i, j) for i in range(i0, i1 + 1) for j in range(j0, j1 + 1)} - at
        frontier = [c for c in empty if c[0] in (i0, i1) or c[1] in (j0, j1)]
        while frontier:
            i, j = frontier.pop()
            if (i, j) in empty:
                empty.remove((i, j))
                frontier += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        want |= {(k, *c) for c in empty}
    got = T.holes(spark.createDataFrame(sorted(own), "room int, i long, j long"), ("room",)).collect()
    assert {(r.room, r.i, r.j) for r in got} == want and len(got) == len(want) > 20


def test_outlines_are_traced_across_batches(spark):
    cells = spark.range(400).where("id % 7 <> 3").select(F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("room"), (F.col("id") * 13 % 9).alias("i"), (F.col("id") * 7 % 11).alias("j"))
    traced = lambda: sorted(T.traced(T.outline(cells.where("room is not null"), ("room",)), ("room",)).collect())
    whole, size = traced(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert traced() == whole and {r.room for r in whole} == {1, 2, 3, 4}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
