"""Queries on openings, walls and the context of regions, bound to `events`, `customer`, `orders`, `lineitem`, `part`, `supplier` and `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import openings as O
from ..operators import rules as R
from ..operators.quantiles import exact_percentiles
from ..plans import levels as L
from ..session import table
from . import points as P
from . import rules as Q

#: Wet rooms here are customers of this segment.
WET = ["household"]


def _rooms(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("room_id"), F.col("c_mktsegment").alias("name"), (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 97 / 10.0).alias("z"), F.lit(0.0).alias("floor_y"), (F.col("c_nationkey") % 3 / 10.0 + 2.4).alias("top_y"))


def _openings(spark, d):
    k = F.col("o_orderkey")
    room = F.concat(F.lit("r"), (F.col("o_custkey") % 150).cast("string"))
    return table(spark, d, "orders").select(
        k.alias("opening_id"), room.alias("room_id"), F.concat(room, F.lit(".W"), (k % 4).cast("string")).alias("wall_id"), (F.col("o_totalprice") / 50000).alias("cx"), (k % 89 / 10.0).alias("cz"),
        (1 - k % 2).cast("double").alias("ux"), (k % 2).cast("double").alias("uz"), (k % 7 / 10.0 + 0.6).alias("width"), F.when(k % 61 == 0, 2).otherwise(1).alias("n_connects"))


def _placed(spark, d):
    made_up = ("is_exterior_wall", "wet_room_dist_m", "corner_dist_m", "height_above_floor_m", "dist_to_ceiling_m", "cx", "cz")
    place = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("value") / 50).alias("cx"), (F.col("event_id") % 83 / 10.0).alias("cz"), (F.col("event_id") % 25 / 10.0).alias("cy"))
    return Q._regions(spark, d).drop(*made_up).join(place, "id")


def region_context(spark, d):
    """Events as regions with their context from rooms and openings: exterior wall, nearest wet room, nearest corner."""
    c = O.region_context(_placed(spark, d), _rooms(spark, d), _openings(spark, d), words=WET)
    return c.select("id", "is_exterior_wall", *[F.round(x, 6).alias(x) for x in ("wet_room_dist_m", "corner_dist_m", "height_above_floor_m", "dist_to_ceiling_m")])


def region_rules_in_context(spark, d):
    c = O.region_context(_placed(spark, d), _rooms(spark, d), _openings(spark, d), words=WET)
    return R.region_flags(c, R.REGION_RULES).select("region_id", "surface_id", "rule", "severity")


def exterior_walls(spark, d):
    o = _openings(spark, d)
    return O.exterior_walls(o.select("wall_id").distinct(), o)


def opening_kinds(spark, d):
    """Lines as openings: how many of each kind the view test gives, with the width used."""
    i = table(spark, d, "lineitem")
    mirror, low = F.when(F.col("l_linenumber") != 7, F.col("l_discount") * 10), F.when(F.col("l_linenumber") != 1, F.col("l_tax") * 10)
    rows = i.withColumn("width", O.opening_width(F.col("l_quantity") / 20, F.col("l_extendedprice") / 20000))
    rows = rows.withColumn("kind", O.opening_kind(F.col("l_extendedprice") / 20000, mirror, low, F.col("width")))
    return rows.groupBy("kind", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("width"), 4).alias("width"))


def opening_kinds_by_gap(spark, d):
    i = table(spark, d, "lineitem")
    kind = O.opening_kind_by_gap(F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", F.col("l_suppkey") % 2 == 0, F.col("l_partkey") % 3 == 0, F.col("l_quantity") / 20)
    return i.groupBy(kind.alias("kind"), "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


def adjacency(spark, d):
    """Nations as rooms that lines between customers and suppliers connect."""
    i = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    i = i.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    kind = F.when(F.col("l_returnflag") == "A", "door").when(F.col("l_returnflag") == "N", "passage").otherwise("window")
    i = i.withColumn("kind", kind).withColumnsRenamed({"c_nationkey": "room_id", "s_nationkey": "other_id"})
    return O.adjacency(i, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"])


def _walls(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    c = F.when(k % 2 == 0, (k % 100).cast("double")).otherwise((k % 10).cast("double"))
    return p.select(k.alias("wall_id"), (k % 2).cast("int").alias("axis"), (c + 0.01).alias("c"), (F.col("p_size") / 10.0).alias("t0"), (F.col("p_size") / 10.0 + 0.5 + F.col("p_size") / 20.0).alias("t1"), (F.col("p_size") / 50.0).alias("coverage"))


def gaps_on_walls(spark, d):
    """Lines as gaps, parts as walls: gaps and their overlap on each wall."""
    i = table(spark, d, "lineitem")
    gaps = i.select(F.col("l_orderkey").alias("gap_id"), (F.col("l_suppkey") % 2).cast("int").alias("axis"), (F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).otherwise(F.col("l_suppkey") % 10) + F.col("l_discount")).alias("c"), (F.col("l_tax") * 50).alias("a"), (F.col("l_tax") * 50 + F.col("l_quantity") / 40 + 0.5).alias("b"))
    return O.gap_totals(gaps, _walls(spark, d)).select("wall_id", "n", F.round("overlap", 4).alias("overlap"))


def _gaps(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    turn = lambda a: F.element_at(F.array(*[F.lit(float(x)) for x in a]), (k % 4 + 1).cast("int"))
    return s.select(k.alias("gap_id"), (F.col("s_acctbal") / 2500 - 2).alias("gx"), (k % 9 / 4.0 - 1).alias("gz"), turn([1, 0, -1, 0]).alias("nx"), turn([0, 1, 0, -1]).alias("nz"), (k % 5 / 2.0 + 1).alias("width"), F.lit(-1.0).alias("floor_y"))


def _rays(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("ray"), *[(F.col("embedding")[i].cast("double") * 8).alias(c) for i, c in enumerate(["cx", "cy", "cz", "px", "py", "pz"])])


def rays_through(spark, d):
    """Embeddings as rays, suppliers as openings: where each ray passes."""
    return O.rays_through(_rays(spark, d), _gaps(spark, d)).select("gap_id", "ray", F.round("along", 6).alias("along"), F.round("height", 6).alias("height"))


def through_ratio(spark, d):
    gaps = _gaps(spark, d)
    return O.through_ratio(O.rays_through(_rays(spark, d), gaps), gaps, F.lit(2.0)).select("gap_id", "hits", *[F.round(c, 6).alias(c) for c in ("ratio", "low", "high")])


def mirrored_share(spark, d):
    """Points of a label beyond a plane through the middle: the share with a point at their mirror image."""
    e = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), *[(F.col("embedding")[i].cast("double")).alias(c) for i, c in enumerate("xyz")])
    planes = e.select("label").distinct().select("label", F.lit(0.0).alias("gx"), F.lit(0.01).alias("gz"), F.cos(F.col("label").cast("double")).alias("nx"), F.sin(F.col("label").cast("double")).alias("nz"))
    return O.mirrored_share(e, planes, ("label",), reach=0.1).select("label", "n", F.round("share", 6).alias("share"))


def _plane_points(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 5000).alias("x"), (F.col("o_orderkey") % 200 / 4.0).alias("z"))


def _planes(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("surface"), (k % 2).cast("int").alias("axis"), F.when(k % 2 == 0, k * 7 % 1000 / 10.0 + 0.013).otherwise(k % 50 + 0.05).alias("c"))


def nearest_plane(spark, d):
    return O.nearest_plane(_plane_points(spark, d), "o_orderkey", _planes(spark, d)).select("o_orderkey", "surface", F.round("residual", 6).alias("residual"))


def surface_votes(spark, d):
    """The surface on which most of a customer's points lie."""
    p = _plane_points(spark, d)
    on = O.nearest_plane(p, "o_orderkey", _planes(spark, d)).join(p.select("o_orderkey", "o_custkey"), "o_orderkey")
    return O.surface_votes(on, p.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), ("o_custkey",))


def level_by_area(spark, d):
    """The level of `events.value` that covers the largest area of (hour, place)."""
    e = table(spark, d, "events")
    found = L.level_peaks(e.select("value"), "value", 2.0, anchor=0.0)
    pts = e.select(F.hour("ts").cast("double").alias("x"), F.col("value").alias("y"), (F.col("event_id") % 40).cast("double").alias("z"))
    return O.levels_by_area(pts, found, (), cell=1.0, window=3.0, share=0.1, least=20).select(F.round("level", 6).alias("level"), F.round("area", 4).alias("area"))


def _density(spark, d):
    i = table(spark, d, "lineitem").select((F.col("l_suppkey") + F.col("l_discount") / 2).alias("x"), (F.col("l_quantity") / 5).alias("z"), (F.col("l_tax") * 30).alias("h"))
    return O.wall_density(i, _walls(spark, d))


def wall_density(spark, d):
    return _density(spark, d).select("wall_id", F.round("density", 4).alias("density"))


def reference_density(spark, d):
    """The median of the walls' densities, 1 without walls."""
    middle = exact_percentiles(_density(spark, d), (), "density", [0.5])
    return middle.agg(F.round(F.coalesce(F.max(F.col("p")[0]), F.lit(1.0)), 6).alias("reference"))


QUERIES = {f.__name__: f for f in (
    region_context, region_rules_in_context, exterior_walls, opening_kinds, opening_kinds_by_gap, adjacency, gaps_on_walls, rays_through, through_ratio, mirrored_share, nearest_plane, surface_votes, level_by_area,
    wall_density, reference_density)}

_OPENINGS = """o AS (SELECT o_orderkey AS opening_id, 'r' || (o_custkey % 150) AS room_id, 'r' || (o_custkey % 150) || '.W' || (o_orderkey % 4) AS wall_id, o_totalprice / 50000 AS cx, (o_orderkey % 89) / 10.0::DOUBLE AS cz,
        CAST(1 - o_orderkey % 2 AS DOUBLE) AS ux, CAST(o_orderkey % 2 AS DOUBLE) AS uz, (o_orderkey % 7) / 10.0::DOUBLE + 0.6::DOUBLE AS width, CASE WHEN o_orderkey % 61 = 0 THEN 2 ELSE 1 END AS n FROM orders)"""
_CONTEXT = f"""{Q._REGIONS}, {_OPENINGS},
    q AS (SELECT r.id, r.room_id, r.surface_id, r.surface_kind, r.cls, r.width_m, r.height_m, e.value / 50 AS px, (e.event_id % 83) / 10.0::DOUBLE AS pz, (e.event_id % 25) / 10.0::DOUBLE AS py FROM r JOIN events e ON e.event_id = r.id),
    m AS (SELECT 'r' || c_custkey AS room_id, c_mktsegment AS name, c_acctbal / 1000 AS x, (c_custkey % 97) / 10.0::DOUBLE AS z, (c_nationkey % 3) / 10.0::DOUBLE + 2.4::DOUBLE AS top FROM customer),
    wt AS (SELECT q.id, min(sqrt((px - x) * (px - x) + (pz - z) * (pz - z))) AS dist FROM q JOIN m ON m.room_id <> q.room_id AND contains(lower(m.name), 'household') WHERE sqrt((px - x) * (px - x) + (pz - z) * (pz - z)) < 2 GROUP BY 1),
    cn AS (SELECT room_id, cx + s * width * ux AS x, cz + s * width * uz AS z FROM o, (SELECT unnest([-0.5, 0.5]::DOUBLE[]) AS s)),
    nr AS (SELECT q.id, min(sqrt((px - x) * (px - x) + (pz - z) * (pz - z))) AS dist FROM q JOIN cn USING (room_id) WHERE surface_kind = 'wall' AND sqrt((px - x) * (px - x) + (pz - z) * (pz - z)) < 0.5 GROUP BY 1),
    cx AS (SELECT q.*, wt.dist AS wet_room_dist_m, nr.dist AS corner_dist_m, surface_kind = 'wall' AND surface_id NOT IN (SELECT wall_id FROM o WHERE n >= 2) AS is_exterior_wall, py AS height_above_floor_m, top - py AS dist_to_ceiling_m
           FROM q LEFT JOIN wt USING (id) LEFT JOIN nr USING (id) JOIN m ON m.room_id = q.room_id)"""
_WALLS = """w AS (SELECT p_partkey AS wall_id, p_partkey % 2 AS axis, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 100 ELSE p_partkey % 10 END + 0.01::DOUBLE AS c, p_size / 10.0::DOUBLE AS t0, p_size / 10.0::DOUBLE + 0.5::DOUBLE + p_size / 20.0::DOUBLE AS t1, p_size / 50.0::DOUBLE AS coverage FROM part)"""
_HITS = """g AS (SELECT s_suppkey AS gap_id, s_acctbal / 2500 - 2 AS gx, (s_suppkey % 9) / 4.0::DOUBLE - 1 AS gz, ([1, 0, -1, 0]::DOUBLE[])[s_suppkey % 4 + 1] AS nx, ([0, 1, 0, -1]::DOUBLE[])[s_suppkey % 4 + 1] AS nz, (s_suppkey % 5) / 2.0::DOUBLE + 1 AS width FROM supplier),
    y AS (SELECT vec_id AS ray, CAST(embedding[1] AS DOUBLE) * 8 AS cx, CAST(embedding[2] AS DOUBLE) * 8 AS cy, CAST(embedding[3] AS DOUBLE) * 8 AS cz, CAST(embedding[4] AS DOUBLE) * 8 AS px, CAST(embedding[5] AS DOUBLE) * 8 AS py, CAST(embedding[6] AS DOUBLE) * 8 AS pz FROM embeddings),
    s AS (SELECT *, -((px - gx) * nx + (pz - gz) * nz) AS sp, -((cx - gx) * nx + (cz - gz) * nz) AS sc FROM y, g),
    t AS (SELECT *, sc / (sc - sp) AS t FROM s WHERE sp > 0.1 AND sp < 4.0 AND sc < -0.05),
    a AS (SELECT gap_id, ray, width, -(cx + t * (px - cx) - gx) * nz + (cz + t * (pz - cz) - gz) * nx AS along, cy + t * (py - cy) + 1 AS height FROM t),
    h AS (SELECT * FROM a WHERE abs(along) < width / 2 - 0.03::DOUBLE AND height > 0.1 AND height < 2.0)"""
_NEAREST = """n AS (SELECT p_partkey AS surface, p_partkey % 2 AS axis, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey * 7 % 1000) / 10.0::DOUBLE + 0.013::DOUBLE ELSE p_partkey % 50 + 0.05::DOUBLE END AS c FROM part),
    p AS (SELECT o_orderkey, o_custkey, o_totalprice / 5000 AS x, (o_orderkey % 200) / 4.0::DOUBLE AS z FROM orders),
    v AS (SELECT o_orderkey, o_custkey, surface, abs(CASE WHEN axis = 0 THEN x ELSE z END - c) AS residual FROM p, n WHERE abs(CASE WHEN axis = 0 THEN x ELSE z END - c) < 0.06),
    b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY residual, surface) = 1)"""
_DENSITY = f"""{_WALLS}, p AS (SELECT l_suppkey + l_discount / 2 AS x, l_quantity / 5 AS z, l_tax * 30 AS h FROM lineitem WHERE l_tax * 30 > 0.1 AND l_tax * 30 < 2.0),
    k AS (SELECT wall_id, count(*) AS n FROM w JOIN p ON (axis = 0 AND abs(x - c) < 0.03 AND z > t0 + 0.1::DOUBLE AND z < t1 - 0.1::DOUBLE) OR (axis = 1 AND abs(z - c) < 0.03 AND x > t0 + 0.1::DOUBLE AND x < t1 - 0.1::DOUBLE) GROUP BY 1),
    dn AS (SELECT wall_id, coalesce(n, 0) / greatest(0.5::DOUBLE, (t1 - t0 - 0.2::DOUBLE) * 1.9::DOUBLE * greatest(coverage, 0.2::DOUBLE)) AS density FROM w LEFT JOIN k USING (wall_id) WHERE t1 - t0 >= 0.8)"""

ORACLE_SQL = {
    "region_context": f"WITH {_CONTEXT} SELECT id, is_exterior_wall, round(wet_room_dist_m, 6) AS wet_room_dist_m, round(corner_dist_m, 6) AS corner_dist_m, round(height_above_floor_m, 6) AS height_above_floor_m, round(dist_to_ceiling_m, 6) AS dist_to_ceiling_m FROM cx",
    "region_rules_in_context": f"WITH {_CONTEXT}, {Q._FLAGS.replace('FROM r WHERE', 'FROM cx WHERE').replace('wet_room_dist_m < 2.0', 'coalesce(wet_room_dist_m < 2.0, false)').replace('corner_dist_m < 0.5', 'coalesce(corner_dist_m < 0.5, false)')} SELECT id AS region_id, surface_id, rule, severity FROM f",
    "exterior_walls": f"WITH {_OPENINGS} SELECT DISTINCT wall_id FROM o WHERE wall_id NOT IN (SELECT wall_id FROM o WHERE n >= 2)",
    "opening_kinds": """WITH v AS (SELECT l_returnflag, l_extendedprice / 20000 AS t, CASE WHEN l_linenumber <> 7 THEN l_discount * 10 END AS m, CASE WHEN l_linenumber <> 1 THEN l_tax * 10 END AS lo,
            CASE WHEN l_extendedprice / 20000 > 0.3 AND l_extendedprice / 20000 < l_quantity / 20 + 0.15::DOUBLE THEN l_extendedprice / 20000 ELSE l_quantity / 20 END AS w FROM lineitem)
        SELECT CASE WHEN t < 0.3 THEN 'unseen' WHEN m > 0.7::DOUBLE THEN 'mirror' WHEN t >= 2.0 AND (lo IS NULL OR lo < 0.7::DOUBLE) THEN CASE WHEN w <= 1.3::DOUBLE THEN 'door' ELSE 'passage' END ELSE 'window' END AS kind, l_returnflag, count(*) AS n, round(sum(w), 4) AS width FROM v GROUP BY 1, 2""",
    "opening_kinds_by_gap": """SELECT CASE WHEN NOT (l_returnflag <> 'R' AND l_linestatus <> 'F' AND l_suppkey % 2 <> 0) THEN CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 2 <> 0 THEN 'window' WHEN l_quantity / 20 <= 1.3::DOUBLE THEN 'door' ELSE 'passage' END END AS kind,
        l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "adjacency": """WITH i AS (SELECT least(c_nationkey, s_nationkey) AS room_a, greatest(c_nationkey, s_nationkey) AS room_b, CASE l_returnflag WHEN 'A' THEN 'door' WHEN 'N' THEN 'passage' ELSE 'window' END AS kind, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)
        SELECT room_a, room_b, CASE WHEN bool_or(kind = 'door') THEN 'door' ELSE first(kind ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) END AS kind, count(*) AS n FROM i GROUP BY 1, 2""",
    "gaps_on_walls": f"""WITH {_WALLS}, g AS (SELECT l_suppkey % 2 AS axis, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey ELSE l_suppkey % 10 END + l_discount AS gc, l_tax * 50 AS a, l_tax * 50 + l_quantity / 40 + 0.5::DOUBLE AS b FROM lineitem),
        x AS (SELECT wall_id, least(b, t1) - greatest(a, t0) AS overlap, b - a AS wide FROM g JOIN w ON g.axis = w.axis AND gc >= c - 0.31 AND gc <= c + 0.31 WHERE abs(gc - c) <= 0.3::DOUBLE)
        SELECT wall_id, count(*) AS n, round(sum(overlap), 4) AS overlap FROM x WHERE overlap >= 0.4::DOUBLE AND overlap >= 0.6::DOUBLE * wide GROUP BY 1""",
    "rays_through": f"WITH {_HITS} SELECT gap_id, ray, round(along, 6) AS along, round(height, 6) AS height FROM h",
    "through_ratio": f"""WITH {_HITS}, k AS (SELECT gap_id, count(*) AS n, quantile_cont(height, 0.03) AS lo, quantile_cont(height, 0.97) AS hi FROM h GROUP BY 1)
        SELECT gap_id, coalesce(n, 0) AS hits, round(coalesce(n, 0) / greatest(width * 1.9::DOUBLE, 0.1::DOUBLE) / 2.0::DOUBLE, 6) AS ratio, round(CASE WHEN n >= 50 THEN lo END, 6) AS low, round(CASE WHEN n >= 50 THEN hi END, 6) AS high FROM g LEFT JOIN k USING (gap_id)""",
    "mirrored_share": """WITH e AS (SELECT label, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
        s AS (SELECT *, x * cos(label) + (z - 0.01::DOUBLE) * sin(label) AS s FROM e), m AS (SELECT label, id, x - 2 * s * cos(label) AS mx, y AS my, z - 2 * s * sin(label) AS mz FROM s WHERE s < 0),
        h AS (SELECT DISTINCT m.label, m.id FROM m JOIN e ON m.label = e.label WHERE (x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz) < 0.1::DOUBLE * 0.1::DOUBLE)
        SELECT m.label, count(*) AS n, round(avg(CASE WHEN h.id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS share FROM m LEFT JOIN h USING (label, id) GROUP BY 1""",
    "nearest_plane": f"WITH {_NEAREST} SELECT o_orderkey, surface, round(residual, 6) AS residual FROM b",
    "surface_votes": f"""WITH {_NEAREST}, k AS (SELECT o_custkey, surface, count(*) AS votes FROM b GROUP BY ALL), t AS (SELECT o_custkey, count(*) AS n FROM p GROUP BY 1),
        r AS (SELECT *, sum(votes) OVER (PARTITION BY o_custkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, surface) AS r FROM k)
        SELECT o_custkey, surface, votes FROM r JOIN t USING (o_custkey) WHERE r = 1 AND a >= n * 0.5::DOUBLE""",
    "level_by_area": f"""WITH {P._PEAKS}, st AS (SELECT level FROM pk WHERE s >= 0.1::DOUBLE * (SELECT max(s) FROM pk)),
        nn AS (SELECT level, hour(ts) AS x, event_id % 40 AS z, count(*) AS n FROM events, st WHERE abs(value - level) < 3.0 GROUP BY ALL), aa AS (SELECT level, CAST(count(*) AS DOUBLE) AS area FROM nn GROUP BY 1 HAVING sum(n) >= 20)
        SELECT round(level, 6) AS level, area FROM aa ORDER BY area DESC, level LIMIT 1""",
    "wall_density": f"WITH {_DENSITY} SELECT wall_id, round(density, 4) AS density FROM dn",
    "reference_density": f"WITH {_DENSITY} SELECT round(coalesce(quantile_cont(density, 0.5), 1.0::DOUBLE), 6) AS reference FROM dn",
}
