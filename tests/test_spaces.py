"""Rooms, borders, drift, placement, comparison and fits on small scenes with a known answer."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import fits, geometry, graphs, histograms, openings, rasters, rules
from plumbline.operators.quantiles import exact_percentiles
from plumbline.plans import comparison, drift, placement, rooms


def cells(spark, spans, key="k"):
    """Cells (capture, i, j) of the boxes (i0, i1, j0, j1), ends left out."""
    return spark.createDataFrame(sorted({(key, i, j) for i0, i1, j0, j1 in spans for i in range(i0, i1) for j in range(j0, j1)}), "capture string, i long, j long")


def test_rooms_are_parted_at_doors(spark):
    """Two rooms of 3 x 2 m joined by a door of 0.9 m; a glass wall of 2 m to ground that nobody entered; a wide gap inside the second room."""
    res = 0.1
    inner = cells(spark, [(0, 30, 0, 20), (30, 31, 6, 15), (31, 61, 0, 20), (61, 62, 0, 20), (62, 80, 0, 20)])
    visited = cells(spark, [(10, 50, 9, 11)])
    gaps = spark.createDataFrame([("k", 1, 3.05, 0.55, 3.05, 1.55, 0.9), ("k", 2, 6.15, 0.05, 6.15, 1.95, 1.9), ("k", 3, 4.5, 0.05, 4.5, 1.95, 1.9)], "capture string, gap_id long, x1 double, z1 double, x2 double, z2 double, width double")
    got = rooms.segment_rooms(inner, visited, gaps, res)
    assert {r.gap_id: r.kind for r in got.where("what = 'closure'").collect()} == {1: "door", 2: "window_or_glass"}
    sizes = {r.label: (r.n, r.lo, r.hi) for r in got.where("what = 'cell'").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi")).collect()}
    assert set(sizes) == {1, 2} and sizes[1][1:] == (0, 28 + (sizes[1][2] - 28)) and sizes[1][2] < 31 <= sizes[2][1] and sizes[2][2] < 62


def test_outline_snaps_to_wall_lines(spark):
    """An L of 4 x 3 m without its upper right corner, with a ragged edge under furniture: the border lies on the walls."""
    res = 0.05
    mask = cells(spark, [(1, 80, 1, 30), (1, 40, 30, 59), (60, 70, 0, 1)]).select("i", "j")
    lines = spark.createDataFrame([(0, 0.0, 0.0, 3.0), (0, 4.0, 0.0, 1.5), (0, 2.0, 1.5, 3.0), (1, 0.0, 0.0, 4.0), (1, 3.0, 0.0, 2.0), (1, 1.5, 2.0, 4.0), (0, 9.0, 0.0, 3.0)], "axis int, c double, a double, b double")
    ring = rooms.snapped_outline(mask, lines, res)
    assert {(r.x, r.z) for r in ring.collect()} == {(0.0, 0.0), (4.0, 0.0), (4.0, 1.5), (2.0, 1.5), (2.0, 3.0), (0.0, 3.0)}
    area = geometry.shoelace(ring.withColumn("g", F.lit(1)), ("g",), "k").collect()[0]
    assert area.area == pytest.approx(9.0) and area.ccw
    assert rooms.snapped_outline(mask.limit(5), lines, res).count() == 0


def test_touching_cells_are_traced_apart(spark):
    got = rasters.traced(rasters.outline(spark.createDataFrame([(0, 0), (1, 1), (5, 5), (5, 6), (5, 7), (6, 5), (6, 7), (7, 5), (7, 6), (7, 7)], "i long, j long")))
    areas = sorted((r.area if r.ccw else -r.area) for r in geometry.shoelace(got.withColumn("g", F.lit(1)), ("g", "ring"), "k", "i", "j").collect())
    assert areas == [-1.0, 1.0, 1.0, 9.0]


def test_the_wall_behind_the_cabinet_wins(spark):
    rng = np.random.default_rng(5)
    pts = [(4.0 + rng.normal(0, 0.003), t, -1.0, 0.0, 1.9, 1.0) for t in np.linspace(0.1, 2.9, 900)] + [(3.85 + rng.normal(0, 0.003), t, -1.0, 0.0, 0.8, 1.0) for t in np.linspace(0.5, 2.5, 3000)]
    points = spark.createDataFrame([tuple(map(float, p)) for p in pts], "x double, z double, nx double, nz double, h double, w double")
    edges = spark.createDataFrame([(1, 0, 3.9, 0.0, 3.0, 1), (2, 0, 0.0, 0.0, 3.0, -1)], "edge int, axis int, c double, lo double, hi double, out int")
    got = {r.edge: r for r in rooms.refined_edges(points, edges).collect()}
    assert set(got) == {1} and got[1].c == pytest.approx(4.0, abs=0.002) and got[1].coverage > 0.9 and got[1].top == pytest.approx(1.9)


def test_drift_is_taken_out(spark):
    """A hall of 12 x 4 m walked along x, in which points shift along z by 1 cm a metre: walls are sharp again."""
    rng = np.random.default_rng(1)
    frames = [("k", f, 0.1 * f, 1.4, 2.0) for f in range(121)]
    rows = []
    for _, f, x, _, _ in frames:
        off = 0.01 * x
        for z, nz in ((0.0, 1.0), (4.0, -1.0)):
            for dx in rng.uniform(-1, 1, 14):
                rows.append(("k", f, x + dx, float(rng.uniform(0.2, 2.2)), z + off + rng.normal(0, 0.002), 0.0, 0.0, nz))
        for dx, dz in rng.uniform(-1, 1, (8, 2)):
            rows.append(("k", f, x + dx, rng.normal(0, 0.002), 2 + dz, 0.0, 1.0, 0.0))
    points = spark.createDataFrame([(k, f, *map(float, v)) for k, f, *v in rows], "capture string, frame int, x double, y double, z double, nx double, ny double, nz double")
    path = spark.createDataFrame([(k, f, float(x), float(y), float(z)) for k, f, x, y, z in frames], "capture string, frame int, cx double, cy double, cz double")
    before = np.array([(r.x, r.z) for r in points.where("nz = 1").collect()])
    after = drift.correct_drift(points, path, iterations=1)
    z = np.array([r.z for r in after.where("nz = 1").collect()])
    assert after.count() == len(rows) and np.std(before[:, 1]) > 0.03 and np.std(z) < 0.75 * np.std(before[:, 1])
    assert drift.halves_spread(points, path).collect()[0].spread < 0.005


ROOMS = [("A", 0, 0, 4, 3), ("corridor", 4.15, 0, 5.35, 6), ("B", 5.5, 0, 9.5, 3), ("C", 4, 6.15, 7.2, 9.15)]
#: (room, door, x, z, nx, nz, width): the normals look into the room.
DOORS = [("A", "E", 4, 1.45, -1, 0, 0.9), ("corridor", "W", 4.15, 1.45, 1, 0, 0.9), ("corridor", "E", 5.35, 1.45, -1, 0, 0.8), ("corridor", "N", 4.75, 6, 0, -1, 0.6), ("B", "W", 5.5, 1.45, 1, 0, 0.8), ("C", "S", 4.75, 6.15, 0, 1, 0.6)]


def test_rooms_are_attached_at_doors(spark):
    """The rooms turned and moved each for itself come back beside each other; without its door a room has no place."""
    turn = lambda x, z, k: [(x, z), (-z, x), (-x, -z), (z, -x)][k]
    moves = {"A": (0, 0, 0), "corridor": (1, 3, -2), "B": (2, -4, 1), "C": (3, 2, 2)}
    boxes, doors = [], []
    for n, x0, z0, x1, z1 in ROOMS:
        k, tx, tz = moves[n]
        (ax, az), (bx, bz) = turn(x0, z0, k), turn(x1, z1, k)
        boxes.append(("p", n, float(min(ax, bx) + tx), float(min(az, bz) + tz), float(max(ax, bx) + tx), float(max(az, bz) + tz)))
    for n, d, x, z, nx, nz, w in DOORS:
        k, tx, tz = moves[n]
        (px, pz), (mx, mz) = turn(x, z, k), turn(nx, nz, k)
        doors.append(("p", n, d, float(px + tx), float(pz + tz), float(mx), float(mz), float(w)))
    b = spark.createDataFrame(boxes, "plan string, room string, x0 double, z0 double, x1 double, z1 double")
    d = spark.createDataFrame(doors, "plan string, room string, door string, x double, z double, nx double, nz double, width double")
    got = placement.attach_rooms(b, d, "plan")
    assert got.where("turns is null").count() == 0, got.collect()
    placed = placement.placed_boxes(b, got.drop("score"), ("plan", "room"))
    assert placement.overlaps(placed, "plan", 0.01).count() == 0
    sides = {r.room: sorted((round(r.x1 - r.x0, 6), round(r.z1 - r.z0, 6))) for r in placed.collect()}
    assert sides == {n: sorted((round(x1 - x0, 6), round(z1 - z0, 6))) for n, x0, z0, x1, z1 in ROOMS}
    span = placed.agg((F.max("x1") - F.min("x0")).alias("w"), (F.max("z1") - F.min("z0")).alias("h")).collect()[0]
    assert sorted((span.w, span.h)) == pytest.approx([9.15, 9.5], abs=0.01)
    lone = placement.attach_rooms(b, d.where("room <> 'C'"), "plan")
    assert [r.room for r in lone.where("turns is null").collect()] == ["C"]


def test_plans_are_compared(spark):
    a = spark.createDataFrame([("p", 1, i, j) for i in range(20) for j in range(12)] + [("p", 2, i, j) for i in range(21, 40) for j in range(12)], "plan string, room int, i long, j long")
    turned = comparison.turned_cells(a, 1).withColumns({"i": F.col("i") + 7, "j": F.col("j") - 3})
    fit = comparison.registration(a, turned, "plan", 3).collect()[0]
    assert fit.turns in (1, 3) and fit.overlap > 0.99
    shifted = a.withColumn("i", F.col("i") + 1).withColumn("room", F.col("room") + 10)
    assert {(r.a, r.b) for r in comparison.room_matches(a, shifted, "plan").collect()} == {(1, 11), (2, 12)}
    walls = spark.createDataFrame([("p", 1, 0.0, 0.0, 4.0, 0.0), ("p", 2, 4.0, 0.0, 4.0, 3.0), ("p", 3, 4.0, 3.0, 0.0, 3.0)], "plan string, wall int, x1 double, z1 double, x2 double, z2 double")
    other = spark.createDataFrame([("p", 21, 0.1, 0.05, 4.1, 0.05), ("p", 22, 4.02, 0.1, 4.02, 3.0), ("p", 23, 0.0, 3.0, 4.0, 3.0), ("p", 24, 0.0, 0.12, 4.0, 0.12)], "plan string, wall int, x1 double, z1 double, x2 double, z2 double")
    got = {(r.a, r.b): r.score for r in comparison.wall_matches(walls, other, "plan").collect()}
    assert set(got) == {(1, 21), (2, 22)}  # 23 looks the other way
    spots = [spark.createDataFrame(rows, "plan string, id int, x double, z double") for rows in ([("p", 1, 0.0, 0.0), ("p", 2, 0.1, 0.0)], [("p", 5, 0.05, 0.0), ("p", 6, 0.3, 0.0), ("p", 7, 5.0, 5.0)])]
    assert {(r.a, r.b) for r in comparison.spot_matches(*spots, ("plan",)).collect()} == {(1, 5), (2, 6)}
    lines = [r.line for r in comparison.report(spark.createDataFrame([("b", None), ("a", 2)], "x string, y int"), "Scores", ["x", "y"], ["x"]).collect()]
    assert lines == ["## Scores", "", "| x | y |", "|---|---|", "| a | 2 |", "| b | - |"]


def test_similarity_with_wrong_matches(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(60, 3))
    a = 0.7
    r = np.array([[math.cos(a), 0, -math.sin(a)], [0, 1, 0], [math.sin(a), 0, math.cos(a)]])
    q = 1.7 * p @ r.T + [1, -2, 0.5] + rng.normal(0, 0.01, (60, 3))
    q[::4] = rng.normal(0, 5, (15, 3))
    noise = [("noise", *map(float, rng.normal(0, 5, 6))) for _ in range(40)]
    rows = [("pair", *map(float, (*x, *y))) for x, y in zip(p, q, strict=True)] + [("few", *([0.0] * 6))] * 3 + noise + [("pair", float("nan"), 0.0, 0.0, 0.0, 0.0, 0.0)]
    got = fits.similarities(spark.createDataFrame(rows, "k string, px double, py double, pz double, qx double, qy double, qz double"), ("k",), iters=500).collect()
    assert len(got) == 1 and got[0].k == "pair" and got[0].inliers == 45 and got[0].s == pytest.approx(1.7, abs=0.01)
    assert np.allclose(np.array(got[0].r).reshape(3, 3), r, atol=0.01) and got[0].t == pytest.approx([1, -2, 0.5], abs=0.02)


def test_depth_of_two_rays(spark):
    rows = []
    for i in range(20):
        x = np.array([0.2 * i - 2, 0.1, 3.0 + 0.1 * i])
        a, b = np.zeros(3), np.array([0.5, 0, 0])
        if i == 3:
            x = np.array([0, 0, 40.0])  # too far
        ray = x - b
        if i in (7, 8):
            ray = ray + [0, 0.002 * (i - 6) * x[2], 0]  # with 1000 pixels of focal length the middle is 1 or 2 pixels and more beside the match
        rows.append(("p", *map(float, (*a, *(x - a), *b, *ray, 0, 0, 1, 0, 0, 1, 1000, 1000, x[2] / 2))))
    names = [f"a{c}" for c in "xyz"] + [f"ad{c}" for c in "xyz"] + [f"b{c}" for c in "xyz"] + [f"bd{c}" for c in "xyz"] + [f"{s}f{c}" for s in "ab" for c in "xyz"] + ["afocal", "bfocal", "mono"]
    df = spark.createDataFrame(rows, "k string, " + ", ".join(f"{n} double" for n in names))
    got = [r.ratio for r in fits.triangulated_ratios(df, ("k",)).collect()]
    assert len(got) == 18 and got == pytest.approx([2.0] * 18, abs=0.01)  # one too far, one more than 2 pixels off
    assert fits.triangulated_ratios(df.limit(5), ("k",)).count() == 0


def test_depth_that_a_neighbour_denies_goes(spark):
    eye = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    frames = spark.createDataFrame([(n, eye, eye, 4.0, 4.0, 4.0, 4.0, 8, 8) for n in (1, 2)], "frame int, pose array<double>, inverse array<double>, fx double, fy double, cx double, cy double, width int, height int")
    pixels = spark.createDataFrame([(n, u, v, 2.0 if (n, u, v) != (1, 3, 3) else 2.5) for n in (1, 2) for u in range(8) for v in range(8)], "frame int, u long, v long, z double")
    pairs = spark.createDataFrame([(1, 2)], "frame int, other int")
    got = fits.consistent_pixels(pixels, frames, pairs)
    assert got.count() == 127 and got.where("frame = 1 and u = 3 and v = 3").count() == 0


def test_a_loop_edge_closes_the_chain(spark):
    nodes = spark.createDataFrame([("k", i, 1.0 * i, 0.1 * i, 0.0) for i in range(5)] + [("open", i, 1.0 * i, 0.1 * i, 0.0) for i in range(3)], "capture string, node int, x double, z double, yaw double")
    steps = [("k", i, i + 1, 1.0, 0.1, 0.0, False) for i in range(4)] + [("k", 0, 4, 4.0, 0.0, 0.0, True)] + [("open", i, i + 1, 1.0, 0.0, 0.0, False) for i in range(2)]
    got = {(r.capture, r.node): (r.x, r.z) for r in fits.closed_chains(nodes, spark.createDataFrame(steps, "capture string, a int, b int, dx double, dz double, dyaw double, loop boolean"), "capture").collect()}
    assert got["k", 0] == (0.0, 0.0) and abs(got["k", 4][1]) < 0.25 and got["open", 2] == (2.0, 0.2)


def test_band_solution_equals_dense(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, float(rng.normal()), float(rng.uniform(0, 3) * (rng.random() > 0.3))) for g, n in ((1, 1), (2, 2), (3, 3), (4, 4), (5, 40)) for i in range(n)]
    got = graphs.smooth_chain(spark.createDataFrame(rows, "g int, i int, m double, w double"), ("g",), "i", "m", "w", 4.0).orderBy("g", "i").toPandas()
    for g in (3, 4, 5):
        part = got[got.g == g]
        k = len(part)
        d = np.zeros((k - 2, k))
        for i in range(k - 2):
            d[i, i : i + 3] = 1, -2, 1
        want = np.linalg.solve(np.diag(part.w + 1e-9) + 4.0 * d.T @ d, part.w * part.m)
        assert np.allclose(part.x, want, atol=1e-5)


def test_hull_of_a_circle_keeps_all_corners(spark):
    pts = [("c", math.cos(2 * math.pi * k / 50) * r, math.sin(2 * math.pi * k / 50) * r) for k in range(50) for r in (5.0, 2.0)] + [("line", 0.0, 1.0 * k) for k in range(4)] + [("dot", 1.0, 1.0)]
    got = {r.k: (r.area, r.n_hull) for r in geometry.hull_areas(spark.createDataFrame(pts, "k string, x double, z double"), ("k",), "x", "z").collect()}
    assert got["c"][0] == pytest.approx(0.5 * 50 * 25 * math.sin(2 * math.pi / 50)) and got["c"][1] == 50
    assert got["line"][0] == 0 and got["dot"] == (0.0, 1)


def test_percentiles_equal_the_exact_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v)) for k, n in (("a", 5000), ("b", 7), ("c", 1)) for v in np.round(rng.exponential(3, n), 2)] + [("a", None)]
    shares = [0.0, 0.001, 0.25, 0.5, 0.97, 1.0]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.p for r in exact_percentiles(df, ("k",), "v", shares, accuracy=100).collect()}
    for k in "abc":
        assert got[k] == pytest.approx(np.quantile([v for g, v in rows if g == k and v is not None], shares).tolist())


def test_percentiles_of_null_keys_and_null_values(spark):
    rows = [(None, 1, 5.0), (None, 1, 7.0), (1, None, 2.0), (1, None, 4.0), (1, None, None), (None, None, 9.0), (2, 2, None)]
    df = spark.createDataFrame(rows, "a int, b int, v double")
    got = {(r.a, r.b): r.p for r in exact_percentiles(df, ("a", "b"), "v", [0.0, 0.5]).collect()}
    assert got == {(None, 1): [5.0, 6.0], (1, None): [2.0, 3.0], (None, None): [9.0, 9.0], (2, 2): [None, None]}
    assert exact_percentiles(df, (), "v", [0.5]).collect()[0].p == [5.0]
    assert {(r.a, r.b): r.med for r in histograms.mad_sigma(df, "v", ("a", "b")).collect()} == {k: v[1] for k, v in got.items()}


def test_openings_of_two_faces_and_narrow_first(spark):
    gaps = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0), (1, 2, 0.0, 0.2, 3.0, 2.8), (1, 3, 0.0, 1.5, 2.4, 0.9)], "wall_id int, gap_id int, c double, a double, b double, overlap double")
    assert sorted(r.gap_id for r in openings.narrowest_apart(gaps).collect()) == [1, 3]
    both = spark.createDataFrame([("r", 1, 0.0, 0.0, 1.0, 0.0, 2.0), ("r", 2, 0.1, 0.1, -1.0, 0.0, 3.0), ("r", 3, 0.1, 0.1, 0.0, 1.0, 9.0)], "room_id string, opening_id int, cx double, cz double, ux double, uz double, through double")
    assert sorted(r.opening_id for r in openings.best_of_both_faces(both).collect()) == [2, 3]


def test_rules_are_checked_when_loaded(spark, tmp_path):
    def stored(name, *rows):
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
        return f"file://{tmp_path}/{name}"

    columns = ["cls string", "length_m double"]
    good = stored("good.json", {"id": "b", "condition": "length_m > 0.5D", "severity": "high"}, {"id": "a", "condition": "cls = 'crack'", "severity": "low"})
    assert [r.id for r in rules.load_rules(spark, good, columns)] == ["a", "b"]
    for bad in ({"id": "x", "condition": "nothing > 1", "severity": "low"}, {"id": "x", "condition": "length_m + 1", "severity": "low"}, {"id": "x", "condition": None, "severity": "low"}):
        with pytest.raises(Exception):  # noqa: B017
            rules.load_rules(spark, stored("bad.json", bad), columns)


def test_smallest_rectangles_equal_all_pairs_of_corners(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for k in range(60):
        n = int(rng.integers(2, 40))
        p = rng.normal(size=(n, 2)) * [3, 1]
        if k % 5 == 0:
            p = np.round(p)  # repeated points, lines and squares
        if k % 7 == 0:
            a = np.linspace(0, 2 * np.pi, n, endpoint=False)
            p = np.stack([np.cos(a), np.sin(a)], 1)
        rows += [(k, float(x), float(z)) for x, z in p]
        turns = [np.arctan2(*(b - a)[::-1]) for a in p for b in p if (a != b).any()]
        if turns:
            want[k] = min(np.ptp(p @ [np.cos(t), np.sin(t)]) * np.ptp(p @ [-np.sin(t), np.cos(t)]) for t in turns)
    got = {r.k: r for r in rooms.smallest_rectangle(spark.createDataFrame(rows, "k int, x double, z double"), ("k",)).collect()}
    assert set(got) == set(want)
    assert all(got[k].length * got[k].width == pytest.approx(want[k], abs=1e-6) and got[k].length >= got[k].width for k in want)


def test_close_values_merge_as_one_pass_does(spark):
    from plumbline.operators import selection

    rng = np.random.default_rng(1)
    rows = [(k, float(v), float(w)) for k in range(9) for v, w in zip(np.round(rng.uniform(0, 5 + 20 * (k % 3), 200), 2), rng.integers(0, 9, 200), strict=True)]
    want = []
    for k in range(9):
        kept = []
        for _, v, w in sorted(r for r in rows if r[0] == k):
            if not kept or v - kept[-1][1] >= 0.3:
                kept.append((k, v, w))
            elif w > kept[-1][2]:
                kept[-1] = (k, v, w)
        want += kept
    df = spark.createDataFrame(rows + [(3, None, 1.0)], "k int, v double, w double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in selection.merge_close(df, ("k",), "v", "w", 0.3).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want)
