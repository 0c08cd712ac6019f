"""Overlay, clusters and other shapes on scenes with a known answer and against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import contours, distances, leaders, overlay, trajectories

RING = "k string, x1 double, z1 double, x2 double, z2 double"


def ring(k, *corners):
    return [(k, *map(float, (*p, *q))) for p, q in zip(corners, (*corners[1:], corners[0]), strict=True)]


def star(rng, x, z, n=9):
    """A simple polygon that is not convex: corners around a middle at changing distances."""
    return [(x + r * math.cos(2 * math.pi * k / n), z + r * math.sin(2 * math.pi * k / n)) for k in range(n) for r in [rng.uniform(0.3, 2.0)]]


def inside(p, corners):
    return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(corners, (*corners[1:], corners[0]), strict=True)) % 2 == 1


def test_overlay_of_known_shapes(spark):
    square = ring("cross", (0, 0), (4, 0), (4, 1), (0, 1)) + ring("same", (0, 0), (2, 0), (2, 2), (0, 2)) + ring("apart", (0, 0), (1, 0), (1, 1), (0, 1)) + ring("hole", (0, 0), (4, 0), (4, 4), (0, 4)) + ring("hole", (1, 1), (3, 1), (3, 3), (1, 3)) + ring("touch", (0, 0), (1, 0), (1, 1), (0, 1)) + ring("alone", (0, 0), (1, 0), (0, 1))
    other = ring("cross", (1, -2), (2, -2), (2, 3), (1, 3)) + ring("same", (2, 2), (0, 2), (0, 0), (2, 0)) + ring("apart", (5, 5), (6, 5), (6, 6), (5, 6)) + ring("hole", (2, 0), (6, 0), (6, 4), (2, 4)) + ring("touch", (1, 0), (2, 0), (2, 1), (1, 1))
    got = {r["k"]: (r["area_a"], r["area_b"], r["common"], r["joint"]) for r in overlay.overlay(spark.createDataFrame(square, RING), spark.createDataFrame(other, RING), ("k",)).collect()}
    want = {"cross": (4, 5, 1, 8), "same": (4, 4, 4, 4), "apart": (1, 1, 0, 2), "hole": (12, 16, 6, 22), "touch": (1, 1, 0, 2), "alone": (0.5, 0, 0, 0.5)}
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    assert overlay.overlay(spark.createDataFrame([], RING), spark.createDataFrame([], RING), ("k",)).count() == 0


def test_overlay_of_stars_against_sampled_points(spark):
    rng = random.Random(2)
    shapes = {f"s{i}": (star(rng, 0, 0), star(rng, rng.uniform(-1, 1), rng.uniform(-1, 1), 13)) for i in range(6)}
    sides = [spark.createDataFrame([e for k, v in shapes.items() for e in ring(k, *v[side])], RING) for side in (0, 1)]
    got = {r["k"]: r for r in overlay.overlay(*sides, ("k",)).collect()}
    step = 0.02
    for k, (a, b) in shapes.items():
        spots = [(inside(p, a), inside(p, b)) for i in range(-160, 160) for j in range(-160, 160) for p in [(i * step + 0.0101, j * step + 0.0103)]]
        for name, hits in (("area_a", sum(x for x, _ in spots)), ("area_b", sum(y for _, y in spots)), ("common", sum(x and y for x, y in spots)), ("joint", sum(x or y for x, y in spots))):
            assert got[k][name] == pytest.approx(hits * step * step, abs=0.03)


def test_consistency_of_views(spark):
    square = lambda c, view, x: [(c, view, x + dx, dz) for dx in (0.0, 1.0) for dz in (0.0, 1.0)]
    rows = square("same", 1, 0.0) + square("same", 2, 0.0) + square("half", 1, 0.0) + square("half", 2, 0.5) + square("three", 1, 0.0) + square("three", 2, 0.0) + square("three", 3, 9.0) + [("one", 4, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "c string, view int, u double, v double")
    got = {r["c"]: (r["n_views"], r["consistency"]) for r in overlay.view_consistency(df, ("c",), "view", "u", "v", pad=0.0001).collect()}
    assert got == {"same": (2, pytest.approx(1)), "half": (2, pytest.approx(1 / 3, abs=1e-3)), "three": (3, pytest.approx(1 / 3)), "one": (1, 1.0)}
    wide = overlay.padded_hulls(spark.createDataFrame([("p", 0.0, 0.0)], "c string, u double, v double"), ("c",), "u", "v", 1.0, 64)
    assert wide.count() == 64 and max(math.hypot(r["x"], r["z"]) for r in wide.collect()) == pytest.approx(1)


def plain_leaders(points, radius):
    found, led = [], {}
    for k, ident, x, z, size in sorted(points, key=lambda p: (p[0], -p[4], p[1])):
        near = next((q for q in found if q[0] == k and (q[2] - x) ** 2 + (q[3] - z) ** 2 < radius * radius), None)
        if near is None:
            found.append((k, ident, x, z))
        led[k, ident] = near[1] if near else ident
    return led


def test_leaders_equal_a_loop(spark):
    rng = random.Random(6)
    points = [("dense", i, rng.uniform(0, 3), rng.uniform(0, 2), rng.randrange(9)) for i in range(400)]  # many ties
    points += [("chain", i, i * 0.3, 0.0, 100 - i) for i in range(30)] + [("rising", i, -i * 0.3, 0.0, i) for i in range(30)] + [("even", i, i * 0.35, 0.0, 1) for i in range(12)] + [("one spot", i, 1.0, 1.0, i % 3) for i in range(40)]
    df = spark.createDataFrame(points, "k string, id long, x double, z double, size long")
    got = {(r["k"], r["id"]): r["leader"] for r in leaders.leader_clusters(df, ("k",), "id", "x", "z", "size", 0.35).collect()}
    assert got == plain_leaders(points, 0.35)
    assert leaders.leader_clusters(df.where("false"), ("k",), "id", "x", "z", "size").count() == 0
    assert leaders.leader_clusters(df.withColumn("x", F.when(F.col("id") > 0, F.col("x"))), ("k",), "id", "x", "z", "size").where("id = 0").count() == 0


def plain_simplified(points, tolerance):
    """Kept indices of an open path, by recursion."""
    if len(points) < 3:
        return set(range(len(points)))
    (ax, az), (bx, bz) = points[0], points[-1]
    length = math.sqrt((bx - ax) ** 2 + (bz - az) ** 2)
    away = [abs((bx - ax) * (z - az) - (bz - az) * (x - ax)) / length if length else math.sqrt((x - ax) ** 2 + (z - az) ** 2) for x, z in points[1:-1]]
    k = max(range(len(away)), key=lambda i: (away[i], -i)) + 1
    if away[k - 1] <= tolerance:
        return {0, len(points) - 1}
    return plain_simplified(points[: k + 1], tolerance) | {i + k for i in plain_simplified(points[k:], tolerance)}


def test_simplified_paths_equal_recursion(spark):
    rng = random.Random(9)
    paths = {"walk": [(i * 0.1, math.sin(i / 9) + rng.uniform(-0.05, 0.05)) for i in range(300)], "line": [(i * 1.0, 0.0) for i in range(40)], "loop": [(math.cos(i), math.sin(i)) for i in range(30)] + [(1.0, 0.0)], "two": [(0.0, 0.0), (1.0, 1.0)], "dot": [(2.0, 2.0)], "still": [(1.0, 1.0)] * 6}
    df = spark.createDataFrame([(k, i, *p) for k, v in paths.items() for i, p in enumerate(v)], "p string, k long, x double, z double")
    got = contours.simplified(df, ("p",), "k", 0.1).collect()
    assert {k: {r["k"] for r in got if r["p"] == k} for k in paths} == {k: plain_simplified(v, 0.1) for k, v in paths.items()} and len(got) == sum(len(plain_simplified(v, 0.1)) for v in paths.values())
    assert contours.simplified(df.where("false"), ("p",), "k", 0.1).count() == 0


def test_simplified_rings_keep_their_corners(spark):
    """The border of an L drawn in steps of a cell, begun at any corner, comes down to its six corners."""
    corners = [(0, 0), (8, 0), (8, 4), (4, 4), (4, 9), (0, 9)]
    steps = [(x0 + (x1 > x0) * k - (x1 < x0) * k, z0 + (z1 > z0) * k - (z1 < z0) * k) for (x0, z0), (x1, z1) in zip(corners, (*corners[1:], corners[0]), strict=True) for k in range(abs(x1 - x0) + abs(z1 - z0))]
    rows = [(f"r{start}", k, *map(float, steps[(start + k) % len(steps)])) for start in (0, 5, 17) for k in range(len(steps))]
    got = contours.simplified_rings(spark.createDataFrame(rows, "r string, k long, x double, z double"), ("r",), "k", 0.5).collect()
    for start in (0, 5, 17):
        mine = sorted((r["k"], r["x"], r["z"]) for r in got if r["r"] == f"r{start}")
        assert {(x, z) for _, x, z in mine} == set(corners) and len(mine) == 6 and all(steps[(start + k) % len(steps)] == (x, z) for k, x, z in mine)


def test_overlaps_are_resolved_by_scale_then_by_push(spark):
    box = lambda p, r, x0, z0, x1, z1: [(p, r, k, float(x), float(z)) for k, (x, z) in enumerate([(x0, z0), (x1, z0), (x1, z1), (x0, z1)])]
    rows = box("scale", "a", 0, 0, 4, 4) + box("scale", "b", 3, 1, 7, 3) + box("push", "a", 0, 0, 4, 4) + box("push", "b", 1, 1, 5, 5) + box("clear", "a", 0, 0, 1, 1) + box("clear", "b", 1, 0, 2, 1)
    rows += [r for k in range(12) for r in box("many", f"m{k:02}", 0, 0, 2, 2)]
    corners = spark.createDataFrame(rows, "plan string, room string, k int, x double, z double")
    doubt = spark.createDataFrame([("scale", "a", 0.1), ("scale", "b", 0.3), ("push", "a", 0.2), ("push", "b", 0.1)], "plan string, room string, doubt double")
    now, changes, left = contours.resolve_overlaps(corners, doubt, "plan", "room", "k", rounds=3)
    told = {(r["plan"], r["room"]): (r["round"], r["other"], r["scale"], r["push"]) for r in changes.where("plan <> 'many'").collect()}
    assert told == {("scale", "b"): (1, "a", pytest.approx(0.5), 0.0), ("push", "a"): (1, "b", 0.4, pytest.approx(4 * 4 * 13 / 79))}
    at = {(r["plan"], r["room"], r["k"]): (r["x"], r["z"]) for r in now.collect()}
    assert at["scale", "b", 0] == pytest.approx((4.0, 1.5)) and at["clear", "b", 0] == (1.0, 0.0) and at["push", "a", 2][0] < 1
    assert changes.where("plan = 'many'").count() == 3 and {r["plan"] for r in left.collect()} == {"many"}  # what three rounds leave is reported
    again = contours.overlapping(now, "plan", "room", "k")
    assert again.where("plan <> 'many'").count() == 0 and again.count() == left.count()


def test_border_distances_equal_brute_force(spark):
    rng = random.Random(12)
    masks = {"noise": {(rng.randrange(24), rng.randrange(20)) for _ in range(430)}, "ring": {(i, j) for i in range(20) for j in range(20) if 3 < math.hypot(i - 9.5, j - 9.5) < 9}, "one": {(5, -7)}, "bar": {(0, j) for j in range(30)}}
    masks["noise"] |= {(i, j) for i in range(5, 17) for j in range(4, 15)}
    df = spark.createDataFrame([(k, *c) for k, v in masks.items() for c in v], "k string, i long, j long")
    got = {(r["k"], r["i"], r["j"]): r["d2"] for r in distances.border_distances(df, ("k",)).collect()}
    for k, mask in masks.items():
        outside = [(i, j) for i in range(-2, 32) for j in range(-10, 33) if (i, j) not in mask]
        assert {c: got[k, *c] for c in mask} == {(i, j): min((i - a) ** 2 + (j - b) ** 2 for a, b in outside) for i, j in mask}
    assert len(got) == sum(map(len, masks.values()))


def test_rooms_joined_by_a_door_are_divided_and_wide_ones_stay(spark):
    box = lambda label, i0, i1, j0, j1: [(i, j, label) for i in range(i0, i1) for j in range(j0, j1)]
    rows = box(1, 0, 40, 0, 30) + box(1, 40, 42, 10, 18) + box(1, 42, 80, 0, 30)  # a neck of 0.8 m
    rows += box(2, 100, 140, 0, 30) + box(2, 140, 142, 2, 28) + box(2, 142, 180, 0, 30)  # an opening of 2.6 m
    rows += box(3, 0, 40, 50, 80) + box(3, 40, 42, 60, 68) + box(3, 42, 55, 54, 66)  # what lies behind the neck is no room
    rows += box(4, 100, 105, 50, 55)  # too narrow for a core
    got = distances.split_at_necks(spark.createDataFrame(rows, "i long, j long, label int"), 0.1).collect()
    parts = {(r["label"], r["part"]) for r in got}
    assert parts == {(1, 1), (1, 2), (2, 1), (3, 1), (4, 1)} and len(got) == len(rows)
    assert {r["part"] for r in got if r["label"] == 1 and r["i"] < 40} == {1} and {r["part"] for r in got if r["label"] == 1 and r["i"] >= 42} == {2}


def test_trajectory_errors_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k, n, noise in (("long", 700, 0.02), ("exact", 40, 0.0), ("short", 2, 0.0), ("still", 5, 0.0)):
        truth = np.cumsum(rng.normal(0, 0.2, (n, 3)), 0) if k != "still" else np.ones((n, 3))
        turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        turn *= np.sign(np.linalg.det(turn))
        guess = (truth * np.linspace(1, 1.3, n)[:, None] if k == "long" else truth) @ turn * 0.7 + [1, 2, 3] + rng.normal(0, noise, (n, 3))
        rows += [(k, i, *map(float, (*guess[i], *truth[i]))) for i in range(n)]
        if n > 5:
            a, b = guess - guess.mean(0), truth - truth.mean(0)
            u, d, v = np.linalg.svd(b.T @ a)
            s = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(v))])
            scale = np.trace(np.diag(d) @ s) / (a**2).sum()
            left = scale * a @ (u @ s @ v).T - b
            steps = [np.linalg.norm(np.diff(x, axis=0), axis=1) for x in (guess, truth)]
            ratio = (steps[0] / steps[1])[steps[1] > 0.01]
            halves = [np.median(ratio[: len(ratio) // 2]), np.median(ratio[len(ratio) // 2 :])]
            want[k] = (n, np.sqrt((left**2).sum(1).mean()), scale, abs(scale - 1) * 100, ratio.std(), abs(halves[1] - halves[0]) / halves[0] * 100)
    df = spark.createDataFrame(rows, "k string, i long, a double, b double, c double, x double, y double, z double").repartition(5)
    got = {r["k"]: tuple(r)[1:] for r in trajectories.trajectory_errors(df, ("k",), "i", ("a", "b", "c"), ("x", "y", "z")).collect()}
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9)
    assert got["short"][0] == 2 and got["still"][4:] == (None, None)


def plain_notches(lines, seen=0.15, short=0.8, rounds=12):
    lines = [list(x) for x in lines]  # k, axis, c, coverage
    for _ in range(rounds):
        n = len(lines)
        size = [abs(lines[(i + 1) % n][2] - lines[i - 1][2]) for i in range(n)]
        bad = [i for i in range(n) if n > 4 and lines[i][3] < seen and size[i] < short]
        if not bad:
            break
        i = min(bad, key=lambda x: (size[x], lines[x][0]))
        p, q = (i - 1) % n, (i + 1) % n
        weight = [lines[x][3] * size[x] for x in (p, q)]
        lines[p][2] = lines[p if weight[0] >= weight[1] else q][2]
        lines[p][3] = sum(weight) / (size[p] + size[q]) if size[p] + size[q] else 0.0
        lines = [x for j, x in enumerate(lines) if j not in (i, q)]
    return lines


def test_notches_are_flattened(spark):
    # 6 x 4 m, with an unseen notch of 0.5 x 0.4 m in the upper wall, and a seen one in the left wall
    notch = [(0, 1, 0.0, 1.0), (1, 0, 6.0, 1.0), (2, 1, 4.0, 0.9), (3, 0, 3.0, 0.0), (4, 1, 3.6, 0.1), (5, 0, 2.5, 0.0), (6, 1, 4.0, 0.8), (7, 0, 0.0, 1.0), (8, 1, 2.0, 0.9), (9, 0, 0.5, 0.9), (10, 1, 1.5, 0.9), (11, 0, 0.0, 1.0)]
    rng = random.Random(21)
    rings = {"notch": notch, "box": [(0, 1, 0.0, 0.0), (1, 0, 0.5, 0.0), (2, 1, 0.5, 0.0), (3, 0, 0.0, 0.0)]}
    for r in range(12):
        rings[f"r{r}"] = [(k, k % 2, round(rng.uniform(0, 2), 1), rng.choice([0.0, 0.1, 0.5, 1.0])) for k in range(2 * rng.randrange(2, 12))]
    df = spark.createDataFrame([(r, *x) for r, v in rings.items() for x in v], "r string, k long, axis int, c double, coverage double")
    found = contours.flattened_notches(df, ("r",)).collect()
    got = {r: sorted((x["k"], x["axis"], x["c"], round(x["coverage"], 9)) for x in found if x["r"] == r) for r in rings}
    assert got == {r: sorted((k, a, c, round(v, 9)) for k, a, c, v in plain_notches(x)) for r, x in rings.items()}
    assert len(got["notch"]) == 8 and len(got["box"]) == 4
    assert (6.0, 4.0) in {(x["x"], x["z"]) for x in found if x["r"] == "notch"}
