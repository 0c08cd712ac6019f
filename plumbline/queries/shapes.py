"""Queries on polygons, clusters and shapes, bound to `part`, `events`, `lineitem` and `supplier`."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import contours as N
from ..operators import distances as B
from ..operators import geometry as X
from ..operators import leaders as C
from ..operators import overlay as V
from ..operators import trajectories as J
from ..operators.grids import label_components
from ..plans import rooms as R
from ..session import table
from . import ordered as Q
from . import points as PQ

_PAD, _DIRECTIONS = 0.2, 8


def hull_iou(spark, d):
    """Overlap of the hulls of each brand's even and odd parts."""
    b = Q._boxes(spark, d)
    side = lambda odd: X.edges(X.hulls(b.where(F.col("p_partkey") % 2 == odd), ("p_brand",), "x0", "z0"), ("p_brand",), "corner")
    o = V.overlay(side(0), side(1), ("p_brand",))
    return o.select("p_brand", *[F.round(c, 5).alias(c) for c in ("area_a", "area_b", "common", "joint")], F.round(F.try_divide("common", "joint"), 6).alias("iou"))


def _views(spark, d):
    e = table(spark, d, "events")
    return e.select("event_type", "user_id", F.hour("ts").alias("view"), (F.col("value") / 100).alias("u"), ((F.col("event_id") % 30) / 10).alias("v"))


def fused_consistency(spark, d):
    """How much the views of each cluster of events cover the same patch."""
    c = V.view_consistency(_views(spark, d), ("event_type", "user_id"), "view", "u", "v", pad=_PAD, directions=_DIRECTIONS)
    return c.select("event_type", "user_id", "n_views", F.round("consistency", 6).alias("consistency"))


def leader_clusters(spark, d):
    """Clusters of events of a type around the largest values."""
    e = table(spark, d, "events").select("event_type", "event_id", (F.col("event_id") * 37 % 1000 / 100).alias("x"), (F.col("user_id") % 97 / 10).alias("z"), F.floor("value").alias("size"))
    return C.leader_clusters(e, ("event_type",), "event_id", "x", "z", "size", 0.35)


def segmented_rooms(spark, d):
    """Rooms of three plans whose inner cells are those that items lie in: cells of each room, and the openings closed."""
    cells = PQ._cells(spark, d).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    plans = cells.withColumn("capture", F.explode(F.array(*[F.lit(f"plan{k}") for k in range(3)])))
    k = F.substring("capture", 5, 1).cast("int")
    inner = plans.where((F.col("n") * 7 + F.col("i") * 3 + F.col("j") + k) % 5 < 3)
    visited = inner.where((F.col("i") + F.col("j")) % 7 < 2).select("capture", "i", "j")
    s = table(spark, d, "supplier").select(F.concat(F.lit("plan"), F.col("s_suppkey") % 3).alias("capture"), F.col("s_suppkey").alias("gap_id"), (F.col("s_suppkey") % 17 * 0.6).alias("x1"), (F.floor("s_acctbal") % 13 * 0.7).alias("z1"), (F.col("s_suppkey") % 5 * 0.6 + 0.6).alias("width"), (F.col("s_suppkey") % 2).alias("turn"))
    gaps = s.select("capture", "gap_id", "x1", "z1", (F.col("x1") + F.col("width") * F.col("turn")).alias("x2"), (F.col("z1") + F.col("width") * (1 - F.col("turn"))).alias("z2"), "width")
    found = R.segment_rooms(inner.select("capture", "i", "j"), visited, gaps, 0.25, area=0.5)
    return found.groupBy("capture", "what", "label", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i"), F.min("j").alias("j"), F.sum("gap_id").alias("gaps"))


def simplified_paths(spark, d):
    """Users' paths through their events without the points near a chord."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").select("user_id", k.alias("k"), (F.col("value") / 10).alias("x"), (F.col("event_id") % 40).cast("double").alias("z"))
    return N.simplified(e, ("user_id",), "k", 8.0)


def resolved_overlaps(spark, d):
    """Suppliers' rooms in plans by nation: how many were scaled or pushed, and which pairs are left."""
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", ((F.col("s_suppkey") % 7) * 1.5).alias("x0"), ((F.floor("s_acctbal") % 5) * 1.3).alias("z0"), (F.col("s_suppkey") % 3 + 1.0).alias("w"), (F.col("s_suppkey") % 2 + 1.5).alias("h"), ((F.col("s_suppkey") % 11) / 10).alias("doubt"))
    spots = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("x0") + F.col("w") * i).alias("x"), (F.col("z0") + F.col("h") * j).alias("z")) for k, (i, j) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])])
    corners = s.select("s_nationkey", "s_suppkey", F.explode(spots).alias("c")).select("s_nationkey", "s_suppkey", "c.*")
    _, changes, left = N.resolve_overlaps(corners, s.select("s_nationkey", "s_suppkey", "doubt"), "s_nationkey", "s_suppkey", "k")
    rest = left.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_left"), F.round(F.sum("common"), 6).alias("area_left"))
    done = changes.groupBy("s_nationkey").agg(F.max("round").alias("rounds"), F.count_if(F.col("push") == 0).alias("n_scaled"), F.count_if(F.col("push") > 0).alias("n_pushed"), F.round(F.min("scale"), 6).alias("least_scale"))
    return done.join(rest, "s_nationkey", "left").na.fill(0, ["n_left", "area_left"])


def border_distances(spark, d):
    """Squared distances of the mask's cells to the nearest cell outside it."""
    c = PQ._cells(spark, d).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).where("(n * 7 + i * 3 + j) % 5 < 4")
    return B.border_distances(c.select("i", "j"))


def divided_rooms(spark, d):
    """Regions of cells where few items lie, divided at their necks: the size of each part."""
    c = PQ._cells(spark, d).withColumn("i", F.floor(F.col("i") / 8)).withColumn("j", F.floor(F.col("j") / 8)).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    dense = c.where("(n * 7 + i * 3 + j) % 5 < 4")
    wide = dense.select("i", "j", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(8) for b in range(8)])).alias("s"))
    cells = wide.select((F.col("i") * 8 + F.col("s.a")).alias("i"), (F.col("j") * 8 + F.col("s.b")).alias("j"))
    return B.split_at_necks(label_components(cells), 0.1, core=0.35, door=1.0, least_core=0.1, least_room=0.5).groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i"), F.min("j").alias("j"))


def trajectory_errors(spark, d):
    """Errors of each user's path as scaled, turned and drifting copies of the events' own places."""
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("value") / 10).alias("x"), (F.col("event_id") % 40).cast("double").alias("y"), (F.hour("ts") / 4).alias("z"))
    seen = e.withColumns({"a": F.col("y") * 0.8 + F.col("x") % 0.5, "b": -F.col("x") * 0.8 + 3, "c": F.col("z") * 0.8 + F.col("y") % 2 / 5})
    out = J.trajectory_errors(seen, ("user_id",), "at", ("a", "b", "c"), ("x", "y", "z"))
    return out.select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("ate", "scale", "scale_error_pct", "ratio_sd", "drift_pct")])


def flattened_notches(spark, d):
    """Rings of lines by customers' orders, without short edges that little supports."""
    o = table(spark, d, "orders").select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("r"), "o_totalprice", "o_orderkey", F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).alias("n"))
    lines = o.where((F.col("r") <= F.floor(F.col("n") / 2) * 2) & (F.col("n") > 3)).select("o_custkey", (F.col("r") - 1).alias("k"), ((F.col("r") - 1) % 2).alias("axis"), (F.floor("o_totalprice") % 40 / 10).alias("c"), (F.col("o_orderkey") % 5 / 10).alias("coverage"))
    found = N.flattened_notches(lines, ("o_custkey",))
    return found.select("o_custkey", "k", "axis", "c", F.round("coverage", 6).alias("coverage"), "x", "z")


QUERIES = {f.__name__: f for f in (border_distances, divided_rooms, trajectory_errors, flattened_notches, simplified_paths, resolved_overlaps, segmented_rooms, hull_iou, fused_consistency, leader_clusters)}


def _hull(points: str, keys: str) -> str:
    """Edges (px, pz, qx, qz) of the convex hulls of `points` (keys, x, z) as a subquery: all other points lie to the left."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    own = ", ".join(f"p.{k}" for k in keys.split(", "))
    cross = "(q.x - p.x) * (r.z - p.z) - (q.z - p.z) * (r.x - p.x)"
    return f"""(SELECT {own}, p.x AS px, p.z AS pz, q.x AS qx, q.z AS qz FROM {points} p JOIN {points} q ON {on("p", "q")} AND (p.x <> q.x OR p.z <> q.z) JOIN {points} r ON {on("r", "p")} GROUP BY ALL
        HAVING min({cross}) >= 0 AND bool_and({cross} > 0 OR ((r.x - p.x) * (q.x - p.x) + (r.z - p.z) * (q.z - p.z) BETWEEN 0 AND (q.x - p.x) * (q.x - p.x) + (q.z - p.z) * (q.z - p.z))))"""


def _overlay(keys: str) -> str:
    """Tables that overlay the edges e (keys, side, px, pz, qx, qz) of two polygons of each key; the last, `overlaid`, has area_a, area_b, common and joint."""
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    a_keys = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""up AS (SELECT {keys}, side, least(px, qx) AS xa, CASE WHEN px < qx THEN pz ELSE qz END AS za, greatest(px, qx) AS xb, (qz - pz) / (qx - px) AS s FROM e WHERE px <> qx),
        crossing AS (SELECT {a_keys}, greatest(a.xa, b.xa) AS lo, least(a.xb, b.xb) AS hi, ((b.za - b.s * b.xa) - (a.za - a.s * a.xa)) / nullif(a.s - b.s, 0) AS x FROM up a JOIN up b ON {same("a", "b")} AND a.side = 0 AND b.side = 1),
        spot AS (SELECT {keys}, xa AS x FROM up UNION SELECT {keys}, xb FROM up UNION SELECT {keys}, x FROM crossing WHERE x > lo AND x < hi),
        strip AS (SELECT {keys}, x AS lo, lead(x) OVER (PARTITION BY {keys} ORDER BY x) AS hi FROM spot QUALIFY hi IS NOT NULL),
        met AS (SELECT {a_keys}, lo, hi, side, za + s * ((lo + hi) / 2 - xa) AS y FROM strip a JOIN up b ON {same("a", "b")} AND xa <= lo AND xb >= hi),
        layer AS (
            SELECT {keys}, (hi - lo) * (lead(y) OVER (PARTITION BY {keys}, lo ORDER BY y, side) - y) AS v,
                   sum(1 - side) OVER w % 2 = 1 AS in_a, sum(side) OVER w % 2 = 1 AS in_b
            FROM met WINDOW w AS (PARTITION BY {keys}, lo ORDER BY y, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        overlaid AS (
            SELECT {keys}, coalesce(sum(v) FILTER (WHERE in_a), 0) AS area_a, coalesce(sum(v) FILTER (WHERE in_b), 0) AS area_b,
                   coalesce(sum(v) FILTER (WHERE in_a AND in_b), 0) AS common, coalesce(sum(v) FILTER (WHERE in_a OR in_b), 0) AS joint
            FROM layer GROUP BY {keys})"""


_TURNS = ", ".join(f"({_PAD * math.cos(2 * math.pi * k / _DIRECTIONS)!r}::DOUBLE, {_PAD * math.sin(2 * math.pi * k / _DIRECTIONS)!r}::DOUBLE)" for k in range(_DIRECTIONS))

ORACLE_SQL = {
    "hull_iou": f"""WITH {Q._BOX}, p AS (SELECT DISTINCT p_brand, p_partkey % 2 AS side, x0 AS x, z0 AS z FROM b), e AS (SELECT * FROM {_hull("p", "p_brand, side")}), {_overlay("p_brand")}
        SELECT p_brand, round(area_a, 5) AS area_a, round(area_b, 5) AS area_b, round(common, 5) AS common, round(joint, 5) AS joint, round(common / nullif(joint, 0), 6) AS iou FROM overlaid""",
    "fused_consistency": f"""WITH t AS (SELECT * FROM (VALUES {_TURNS}) AS t(dx, dz)),
        p AS (SELECT DISTINCT event_type, user_id, hour(ts) AS view, value / 100 + dx AS x, (event_id % 30) / 10 + dz AS z FROM events, t),
        h AS (SELECT * FROM {_hull("p", "event_type, user_id, view")}),
        x AS (SELECT event_type, user_id, view, min(px) AS x0, max(px) AS x1, min(pz) AS z0, max(pz) AS z1 FROM h GROUP BY ALL),
        o AS (
            SELECT a.event_type, a.user_id, a.view AS v1, b.view AS v2 FROM x a JOIN x b ON a.event_type = b.event_type AND a.user_id = b.user_id AND a.view < b.view
            WHERE a.x0 < b.x1 AND b.x0 < a.x1 AND a.z0 < b.z1 AND b.z0 < a.z1),
        e AS (
            SELECT o.event_type, o.user_id, v1, v2, 0 AS side, px, pz, qx, qz FROM o JOIN h ON h.event_type = o.event_type AND h.user_id = o.user_id AND view = v1
            UNION ALL SELECT o.event_type, o.user_id, v1, v2, 1, px, pz, qx, qz FROM o JOIN h ON h.event_type = o.event_type AND h.user_id = o.user_id AND view = v2),
        {_overlay("event_type, user_id, v1, v2")},
        s AS (SELECT event_type, user_id, sum(common / joint) AS total FROM overlaid GROUP BY ALL)
        SELECT event_type, user_id, count(*) AS n_views, round(CASE WHEN count(*) = 1 THEN 1.0::DOUBLE ELSE coalesce(max(total), 0) / (count(*) * (count(*) - 1) / 2) END, 6) AS consistency
        FROM x LEFT JOIN s USING (event_type, user_id) GROUP BY ALL""",
    "border_distances": """WITH g AS (SELECT l_partkey % 64 AS i, l_suppkey % 64 AS j, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT i, j FROM g WHERE (n * 7 + i * 3 + j) % 5 < 4),
        x AS (SELECT min(i) - 1 AS i0, max(i) + 1 AS i1, min(j) - 1 AS j0, max(j) + 1 AS j1 FROM c),
        o AS (SELECT i, j FROM (SELECT unnest(range(i0, i1 + 1)) AS i FROM x), (SELECT unnest(range(j0, j1 + 1)) AS j FROM x) WHERE (i, j) NOT IN (SELECT (i, j) FROM c))
        SELECT c.i, c.j, min((c.i - o.i) * (c.i - o.i) + (c.j - o.j) * (c.j - o.j)) AS d2 FROM c, o GROUP BY c.i, c.j""",
    "simplified_paths": """WITH RECURSIVE p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value / 10 AS x, CAST(event_id % 40 AS DOUBLE) AS z FROM events),
        r AS (
            SELECT user_id, min(k) AS a, max(k) AS b FROM p GROUP BY user_id
            UNION ALL
            SELECT user_id, unnest([a, -m['k']]), unnest([-m['k'], b]) FROM (
                SELECT user_id, a, b, max({'away': away, 'k': -k}) AS m
                FROM (SELECT r.user_id, r.a, r.b, q.k, abs((b.x - a.x) * (q.z - a.z) - (b.z - a.z) * (q.x - a.x)) / sqrt((b.x - a.x) * (b.x - a.x) + (b.z - a.z) * (b.z - a.z)) AS away
                      FROM r JOIN p a ON a.user_id = r.user_id AND a.k = r.a JOIN p b ON b.user_id = r.user_id AND b.k = r.b JOIN p q ON q.user_id = r.user_id AND q.k > r.a AND q.k < r.b)
                GROUP BY user_id, a, b) WHERE m['away'] > 8)
        SELECT DISTINCT p.user_id, p.k, p.x, p.z FROM r JOIN p ON p.user_id = r.user_id AND (p.k = r.a OR p.k = r.b)""",
    "leader_clusters": """WITH RECURSIVE p AS (
            SELECT event_type, event_id, (event_id * 37 % 1000) / 100 AS x, (user_id % 97) / 10 AS z, row_number() OVER (PARTITION BY event_type ORDER BY floor(value) DESC, event_id) AS k FROM events),
        r AS (
            SELECT DISTINCT event_type, 0::BIGINT AS k, []::STRUCT(id BIGINT, x DOUBLE, z DOUBLE)[] AS l, 0::BIGINT AS event_id, 0::BIGINT AS leader FROM p
            UNION ALL
            SELECT event_type, k, CASE WHEN near IS NULL THEN list_append(l, {'id': event_id, 'x': x, 'z': z}) ELSE l END, event_id, coalesce(near, event_id)
            FROM (SELECT r.event_type, p.k, l, p.event_id, p.x, p.z, list_filter(l, lambda q: (p.x - q.x) * (p.x - q.x) + (p.z - q.z) * (p.z - q.z) < 0.35::DOUBLE * 0.35::DOUBLE)[1].id AS near
                  FROM r JOIN p ON p.event_type = r.event_type AND p.k = r.k + 1))
        SELECT event_type, event_id, leader FROM r WHERE k > 0""",
}
