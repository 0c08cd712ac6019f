"""Core operators on small tables with known answers."""

from __future__ import annotations

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import measure as M
from plumbline.functions import text as T
from plumbline.operators import geometry as X
from plumbline.operators import graphs as R
from plumbline.operators import grids as G
from plumbline.operators import histograms as H
from plumbline.operators import joins as J
from plumbline.operators import points as P
from plumbline.operators import rules
from plumbline.operators import sequences as S
from plumbline.plans import documents as D
from plumbline.plans import levels as L
from plumbline.sources import captures as C
from plumbline.streaming import windows as W


def test_backproject_a_tilted_plane(spark):
    """Depth of a wall that falls away to the right: one normal everywhere, turned to the camera, borders dropped."""
    rows = [(0, u, v, 2.0 / (1 - 0.5 * (u - 10) / 100.0), True, 100.0, 100.0, 10.0, 8.0) for u in range(20) for v in range(16)]
    got = P.backproject(spark.createDataFrame(rows, "frame int, u int, v int, z double, valid boolean, fx double, fy double, cx double, cy double")).toPandas()
    assert len(got) == 18 * 14
    assert np.allclose(got[["nx", "ny", "nz"]], np.array([0.5, 0, -1]) / math.hypot(0.5, 1), atol=1e-3)
    assert len(P.backproject(spark.createDataFrame([(*r[:3], 2.0, r[1] != 7, *r[5:]) for r in rows], "frame int, u int, v int, z double, valid boolean, fx double, fy double, cx double, cy double"), stride=2).toPandas()) < 9 * 7


def test_pose_round_trip(spark):
    q = (math.sin(0.3), 0.0, 0.0, math.cos(0.3))
    row = spark.range(1).select(M.quaternion_matrix(*[F.lit(x) for x in (*q, 1.0, 2.0, 3.0)]).alias("m"))
    x, y, z = row.select(*M.affine(F.col("m"), F.lit(0.0), F.lit(1.0), F.lit(0.0))).first()
    assert (x, y, z) == pytest.approx((1.0, 2.0 + math.cos(0.6), 3.0 + math.sin(0.6)))


def test_floor_of_noisy_levels(spark):
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.normal(0.0, 0.005, 4000), rng.normal(0.74, 0.01, 500), rng.uniform(0, 2.5, 800)])
    df = spark.createDataFrame([(float(v),) for v in y], "y double")
    r = L.lowest_level(df, "y", 0.01, 0.04).first()
    assert abs(r.value) < 0.002 and r.ci_lo < 0 < r.ci_hi
    few = H.robust_level(df.limit(5).withColumn("k", F.lit(1)).withColumn("y", F.lit(0.01)).withColumn("g", F.lit(0.0)), "y", "g", 0.04, keys=("k",)).first()
    assert (few.level, few.sd, few.n) == (0.0, 0.04, 5)
    assert L.lowest_level(df.where("false"), "y", 0.01, 0.04).count() == 0


def test_suppression_by_rejected_peaks(spark):
    df = spark.createDataFrame([(0, 1, 1.00, 9.0), (0, 5, 1.05, 8.0), (0, 9, 1.09, 7.0), (0, 20, 2.0, 1.0)], "k int, bin long, level double, s double")
    assert sorted(r.level for r in H.suppress(df, ("k",)).collect()) == [1.00, 1.09, 2.0]


def test_keyframes_compare_with_the_last_kept(spark):
    rows = [(0, i, 0.03 * i, 0.0, 0.0) for i in range(10)] + [(1, i, 0.0, 0.0, 0.06 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, i int, x double, z double, turn double")
    got = S.keyframes(df, ["k"], ["i"], ["x", "z"], "turn")
    assert sorted((r.k, r.i) for r in got.collect()) == [(0, 0), (0, 2), (0, 4), (0, 6), (0, 8), (1, 0), (1, 2), (1, 4)]
    even = S.evenly(spark.range(10_000).withColumn("k", F.lit(0)), ["k"], ["id"], 400).collect()
    assert sorted(r.id for r in even) == sorted({int(k * 9999 / 399) for k in range(400)})


def test_intervals(spark):
    gaps = spark.createDataFrame([(0, 1, 1.0, 2.0), (0, 2, 3.0, 4.0), (0, 3, 3.9, 5.0)], "k int, g int, a double, b double")
    solid = spark.createDataFrame([(0, 3.5, 3.94), (0, 9.0, 99.0)], "k int, c double, e double")
    assert sorted(r.g for r in J.not_covered(gaps, solid, ("a", "b"), ("c", "e"), ["k", "g"], 0.7, ("k",)).collect()) == [1, 3]
    assert sorted((r.g, round(r.overlap, 6)) for r in J.overlap_join(gaps, solid, ("a", "b"), ("c", "e"), 0.3, ("k",)).collect()) == [(2, 0.44), (3, 0.04)]


def test_nearest_anchor_ties_go_up(spark):
    rows, anchors = spark.createDataFrame([(0, 1.0), (0, 0.4), (0, 9.0)], "k int, v double"), spark.createDataFrame([(0, 0.5), (0, 1.5)], "k int, a double")
    got = {r.v: r.anchor for r in J.nearest_anchor(rows, anchors, "v", "a", ("k",), 0.6).collect()}
    assert got == {1.0: 1.5, 0.4: 0.5, 9.0: None}


def test_greedy_pairs(spark):
    df = spark.createDataFrame([(0, 1, 1, 0.9), (0, 1, 2, 0.8), (0, 2, 1, 0.85), (0, 2, 2, 0.1)], "k int, a int, b int, s double")
    assert sorted((r.a, r.b) for r in J.greedy_pairs(df, ("k",), "a", "b", "s").collect()) == [(1, 1), (2, 2)]


def test_morphology_at_the_border(spark):
    cells = spark.createDataFrame([(i, j) for i in range(5) for j in range(5)], "i long, j long")
    assert G.erode(cells, G.SQUARE).count() == 9 and G.opened(cells).count() == 25 and G.closed(cells).count() == 25 and G.dilate(cells).count() == 45


def test_growth_and_components(spark):
    domain = spark.createDataFrame([(0, j) for j in range(7)] + [(5, 5)], "i long, j long")
    markers = spark.createDataFrame([(0, 0, 1), (0, 6, 2)], "i long, j long, label int")
    assert {(r.j, r.label) for r in G.grow(markers, domain).collect()} == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2)}
    assert {(r.i, r.j): r.label for r in G.label_components(domain).collect()} == {**{(0, j): 1 for j in range(7)}, (5, 5): 2}


def test_forest_and_chain(spark):
    edges = spark.createDataFrame([(1, 0, 1, 5, 2.0), (2, 1, 2, 50, 0.5), (3, 0, 2, 3, 9.0), (4, 3, 4, 10, 4.0)], "edge long, x long, y long, weight long, r double")
    nodes = spark.range(6).withColumnRenamed("id", "node")
    forest = R.spanning_forest(nodes, edges.drop("r"))
    assert sorted(r.edge for r in forest.collect()) == [1, 2, 4]
    chained = R.chain_ratios(forest.join(edges.select("edge", "r"), "edge"), nodes.where("node in (2, 3)"), "r").collect()
    assert {r.node: r.value for r in chained} == {2: 1.0, 1: 2.0, 0: 1.0, 3: 1.0, 4: 4.0}


def test_smooth_chain_keeps_a_ramp(spark):
    df = spark.createDataFrame([(0, i, 0.5 * i, 0.0 if i == 3 else 1.0) for i in range(8)], "k int, i int, m double, w double")
    assert [r.x for r in R.smooth_chain(df, ("k",), "i", "m", "w", 4.0).orderBy("i").collect()] == pytest.approx([0.5 * i for i in range(8)], abs=1e-6)


def test_polygons(spark):
    ring = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 4.0, 0.0), (0, 2, 4.0, 3.0), (0, 3, 0.0, 3.0)], "k int, o int, x double, z double")
    r = X.shoelace(ring, ("k",), "o").first()
    assert (r.area, r.ccw, r.perimeter) == (12.0, True, 14.0)
    pts = spark.createDataFrame([(1, 2.0, 1.0), (2, 5.0, 1.0), (3, 0.1, 2.9)], "p int, px double, pz double")
    assert sorted(r.p for r in X.points_in_polygons(pts, X.edges(ring, ("k",), "o"), ("k",), "p", "px", "pz", 1.0).collect()) == [1, 3]
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 4.0, 3.0), (0, 3.0, 1.0, 6.0, 2.0), (0, 1.0, 1.0, 2.0, 2.0)], "k int, x0 double, z0 double, x1 double, z1 double")
    assert X.union_area(boxes, ("k",)).first().area == 14.0
    assert X.hull_areas(ring.union(spark.createDataFrame([(0, 9, 1.0, 1.0)], ring.schema)), ("k",), "x", "z").first().area == 12.0


def test_interpolation_is_flat_beyond_the_ends(spark):
    known = spark.createDataFrame([(0, 1.0, 10.0), (0, 3.0, 30.0)], "k int, t double, v double")
    got = S.interpolate(spark.createDataFrame([(0, t) for t in (0.0, 1.0, 2.5, 9.0)], "k int, t double"), known, "t", "v", ("k",)).orderBy("t").collect()
    assert [r.v for r in got] == [10.0, 10.0, 25.0, 30.0]


REGIONS = [  # id, cls, surface, kind, x, y, z, w, h, exterior, wet distance, corner distance
    ("d.ceiling", "water_stain", "room0.ceiling", "ceiling", 1.5, 2.4, 0.2, 0.3, 0.3, False, 3.0, 9.0), ("d.wall_base", "water_stain", "room0.W0", "wall", 1.5, 0.1, 0.0, 0.3, 0.3, True, 3.04, 9.0),
    ("d.mould_ext", "mould", "room0.W0", "wall", 1.0, 1.0, 0.0, 0.3, 0.3, True, 3.5, 9.0), ("d.wall_top", "water_stain", "room0.W0", "wall", 1.5, 2.3, 0.2, 0.3, 0.3, True, 3.0, 9.0),
    ("d.crack", "crack", "room0.W1", "wall", 3.0, 1.2, 1.9, 0.6, 0.02, False, 2.1, 0.1), ("d.near_wet", "mould", "room0.W0", "wall", 2.9, 1.0, 0.0, 0.3, 0.3, True, 1.67, 1.0)]


def test_rules_and_scope(spark):
    df = spark.createDataFrame(
        [(i, "room0", s, k, c, w, h, y, 2.4 - y, e, wet, d, x, z, False, w * h, 0.01) for i, c, s, k, x, y, z, w, h, e, wet, d in REGIONS],
        "id string, room_id string, surface_id string, surface_kind string, cls string, width_m double, height_m double, height_above_floor_m double, dist_to_ceiling_m double, is_exterior_wall boolean, "
        "wet_room_dist_m double, corner_dist_m double, cx double, cz double, low_confidence boolean, area_m2 double, sigma double")
    flags = rules.region_flags(df, rules.REGION_RULES)
    by = {}
    for r in flags.collect():
        by.setdefault(r.rule, set()).add(r.region_id)
    assert by == {"ceiling_water_stain": {"d.ceiling"}, "wall_base_moisture": {"d.wall_base"}, "exterior_wall_mould": {"d.mould_ext", "d.near_wet"}, "near_wet_room_moisture": {"d.near_wet"}, "structural_crack": {"d.crack"}}
    assert [(r.a_id, r.b_id) for r in rules.pair_flags(df, rules.PAIR_RULE, 0.75).collect()] == [("d.ceiling", "d.wall_top")]
    surfaces = spark.createDataFrame([("room0.W0", 3.0, 2.4), ("room0.W1", 3.0, 2.4), ("room0.ceiling", 3.0, 3.0)], "surface_id string, length_m double, height double")
    items = {(r.code, r.surface_id): r for r in rules.scope_items(df, surfaces, rules.SCOPE_RULES).collect()}
    repaint = items["09.91-REPAINT-SURF", "room0.W0"]
    assert repaint.n == 4 and repaint.value == pytest.approx(7.2) and len(repaint.triggered_by) == 4
    assert items["01.74-MOLD-REMED", "room0.W0"].value == pytest.approx(2 * 0.09 * 1.3) and items["09.21-CRACK-FILL", "room0.W1"].value == pytest.approx(0.6)
    assert [r.flag_id for r in rules.numbered_flags(flags).orderBy("flag_id").limit(2).collect()] == ["concealed.0001", "concealed.0002"]


def test_measurements(spark):
    m = spark.range(1).select(M.length(F.lit(4.0), F.lit(0.003), F.lit(0.004), F.lit(0.0)).alias("m")).select("m", M.rounded(F.col("m")).alias("r")).first()
    assert m.m.sigma == pytest.approx(0.005) and m.r.ci95 == [3.9902, 4.0098] and m.m.budget["plane_a"] == 0.003


def test_text(spark):
    row = spark.range(1).select(T.slug(F.lit(" Big Hall-2 ")), T.slug(F.lit("!!")), T.extension(F.lit("a/b.HEIC")), T.numbered(F.lit("scope"), F.lit(7))).first()
    assert tuple(row) == ("big_hall_2", "room", "heic", "scope.0007")


def _png(a: np.ndarray, kind: int) -> bytes:
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    step = a.dtype.itemsize
    raw = a.astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(a.shape[0], -1).astype(int)
    rows = []
    for y in range(len(raw)):
        up = raw[y - 1] if y else raw[0] * 0
        left, corner = np.concatenate([[0] * step, raw[y][:-step]]), np.concatenate([[0] * step, up[:-step]])
        p = left + up - corner
        nearest = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        rows.append(bytes([kind]) + ((raw[y] - [raw[y] * 0, left, up, (left + up) // 2, nearest][kind]) % 256).astype(np.uint8).tobytes())
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8 * step, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_depth_images(spark):
    depth = np.array([[100, 150, 151, 4999, 5000, 700], [65535, 900, 901, 902, 40000, 3000]], np.uint16)
    conf = np.array([[2, 2, 2, 2, 2, 1], [2, 2, 1, 0, 2, 2]], np.uint8)
    for kind in range(5):
        assert (C.decode_png(_png(depth, kind)) == depth).all() and (C.decode_png(_png(conf, kind)) == conf).all()
    df = spark.createDataFrame([(3, bytearray(_png(depth, 4)), bytearray(_png(conf, 1)))], "frame int, depth binary, conf binary")
    assert sorted((r.u, r.v, r.z) for r in C.depth_pixels(df).collect()) == [(1, 1, 0.9), (2, 0, 0.151), (3, 0, 4.999), (5, 1, 3.0)]


def test_capture_sources(spark, tmp_path):
    cap = tmp_path / "cap"
    (cap / "depth").mkdir(parents=True)
    (cap / "depth" / "000000.png").write_bytes(b"x")
    (cap / "odometry.csv").write_text("timestamp, frame, x, y, z, qx, qy, qz, qw, fx, fy, cx, cy, more\n0.5, 0, 1, 2, 3, 0, 0, 0, 1, 1440, 1440, 960, 720, 9\n0.6, 1, 1, 2, 3, 0, 0, 0, 1, NaN, 1440, 960, 720, 9\n")
    assert C.detect_tier(C.files(spark, str(cap))).first().tier == "lidar"
    frames = C.read_odometry(spark, str(cap / "odometry.csv"), (1.0, 2.0, 3.0, 4.0)).orderBy("frame").collect()
    assert [(r.fx, r.cy) for r in frames] == [(1440.0, 720.0), (1.0, 4.0)] and frames[0].pose[3] == 1.0 and frames[0].dfx == pytest.approx(192.0)
    posed = tmp_path / "posed"
    posed.mkdir()
    eye = [[1, 0, 0, 5], [0, 1, 0, 6], [0, 0, 1, 7], [0, 0, 0, 1]]
    (posed / "transforms.json").write_text(json.dumps({"w": 8, "h": 6, "fl_x": 10.0, "cx": 4.0, "cy": 3.0, "frames": [{"file_path": "images/1", "transform_matrix": eye}, {"file_path": "b.jpg", "transform_matrix": eye, "fl_x": 11.0, "cx": 4.5}]}))
    rows = C.read_manifest(spark, str(posed / "transforms.json")).orderBy("frame").collect()
    assert [(r.file, r.fx, r.fy, r.cx) for r in rows] == [("images/1.png", 10.0, 10.0, 4.0), ("b.jpg", 11.0, 11.0, 4.5)] and rows[0].pose[:8] == [1, 0, 0, 5, 0, -1, 0, 6]
    assert C.detect_tier(C.files(spark, str(posed))).first().tier == "video"
    photos = tmp_path / "photos"
    for room in ("hall", "bath"):
        (photos / room).mkdir(parents=True)
        (photos / room / "2.JPG").write_bytes(b"x")
        (photos / room / "note.txt").write_bytes(b"x")
    listed = C.files(spark, str(photos))
    assert C.detect_tier(listed).first().tier == "photo" and sorted((r.room, r.file) for r in C.photo_rooms(listed, "file:" + str(photos)).collect()) == [("bath", "2.JPG"), ("hall", "2.JPG")]
    assert C.tier_errors(spark).count() == 4


def test_documents(spark, tmp_path):
    parents, children = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), spark.createDataFrame([("a", 2, 0.5), ("a", 1, 1.5)], "pid string, k int, v double")
    docs = D.nested(parents, children, "id", "pid", ["k", "v"], "items")
    C.write_documents(docs, str(tmp_path / "out"))
    back = {r.id: [tuple(x) for x in r["items"] or []] for r in spark.read.schema(docs.schema).json(str(tmp_path / "out")).collect()}
    assert back == {"a": [(1, 1.5), (2, 0.5)], "b": []}
    assert "<polygon" in D.svg([{"polygon": [(0, 0), (4, 0), (4, 3)], "kind": "room"}], [{"start": (0, 0), "end": (4, 0), "length": 4.0, "observed": False}])


def test_stream_equals_batch(spark, small_dir):
    from plumbline.queries.ordered import _walk
    from plumbline.queries.streams import stream_keyframes

    batch = S.keyframes(_walk(spark, small_dir).withColumn("turn", F.col("z") * 6.0), ["user_id"], ["ts", "event_id"], ["x", "z"], "turn", min_trans=6.0, min_rot=60.0, most=None)
    assert sorted((r.user_id, r.event_id) for r in batch.collect()) == sorted((r.user_id, r.event_id) for r in stream_keyframes(spark, small_dir).collect())
    assert W.sessions(W.stream_of(spark, f"{small_dir}/events.parquet"), "ts", "1 hour", "1 day", ("user_id",)).isStreaming


@pytest.mark.parametrize("parts", [1, 7])
def test_same_result_under_other_partitions(spark, small_dir, parts):
    from plumbline.queries import QUERIES

    want = sorted(map(tuple, QUERIES["voxel_downsample"](spark, small_dir).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert sorted(map(tuple, QUERIES["voxel_downsample"](spark, small_dir).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_flags_beyond_9999_are_numbered_in_ranges(spark):
    flags = spark.range(10_050).select((F.col("id") * 7919 % 10_050).alias("region_id"), F.lit(0).alias("place"))
    numbered = rules.numbered_flags(flags)
    got = {r.region_id: r.flag_id for r in numbered.collect()}
    assert got == {i: f"concealed.{i + 1:04d}" for i in range(10_050)}
    assert "SinglePartition" not in flags.sparkSession._jvm.PythonSQLUtils.explainString(numbered._jdf.queryExecution(), "simple").split("BroadcastExchange")[0]


def test_fingerprints_hold_no_group(spark):
    import hashlib

    from plumbline.plans import documents

    rows = [("a", f"f{i}", i) for i in range(3000)] + [("b", "x", 1), (None, "y", 2), ("b", "w", None)]
    found = documents.fingerprint(spark.createDataFrame(rows, "host string, name string, size long"), ("host",), F.col("name"), F.col("size"))
    want = {h: hashlib.sha1("".join(f"{n}:{s}" for k, n, s in sorted(rows, key=lambda r: r[1]) if k == h and s is not None).encode()).hexdigest() for h in ("a", "b", None)}
    assert {r.host: r.fingerprint for r in found.collect()} == want
    assert "collect_list" not in spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")


def test_late_regions_of_a_room_are_paired(spark):
    rows = [(i, "r1", "water_stain", "ceiling" if i == 449 else "wall", float(i), 0.0) for i in range(449)] + [(449, "r1", "water_stain", "ceiling", 448.5, 0.0)]
    df = spark.createDataFrame(rows, "id long, room_id string, cls string, surface_kind string, cx double, cz double").selectExpr("*", "0.1D width_m", "0.1D height_m", "0.1D dist_to_ceiling_m", "9.0D wet_room_dist_m", "9.0D corner_dist_m")
    assert [(r.a_id, r.b_id) for r in rules.pair_flags(df, rules.PAIR_RULE, 0.75).collect()] == [(448, 449)]
    assert rules.pair_flags(df, rules.PAIR_RULE, 0.75, most=rules.ENGINE_MOST).count() == 0


def test_long_chains_are_followed_to_their_end(spark):
    from plumbline.operators import graphs

    forest = spark.createDataFrame([(i, i + 1, 1.0) for i in range(63)], "x long, y long, ratio double")
    got = {r.node: r.hops for r in graphs.chain_ratios(forest, spark.createDataFrame([(0,)], "node long"), "ratio").collect()}
    assert got == {i: i for i in range(64)}
