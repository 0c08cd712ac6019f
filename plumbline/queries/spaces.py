"""Queries on rasters, rooms and placements, bound to `lineitem`, `supplier`, `part`, `nation`, `customer` and `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits as Z
from ..operators import geometry as X
from ..operators import rasters as T
from ..plans import placement as L
from ..plans import rooms as R
from ..session import table
from . import openings as O
from . import ordered as Q
from . import points as PQ


def _r(**columns) -> list:
    return [F.round(v, 6).alias(k) for k, v in columns.items()]


def _mask(spark, d):
    c = PQ._cells(spark, d).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    return c.where("(n * 7 + i * 3 + j) % 5 < 3").select("i", "j")


def holes(spark, d):
    """Empty cells that the mask encloses."""
    return T.holes(_mask(spark, d)).select("i", "j")


def interior(spark, d):
    c = PQ._cells(spark, d).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    return T.interior(c.where("(n + i) % 11 = 0").select("i", "j"), c.where("n % 2 = 0").select("i", "j"), c.select("i", "j", (F.col("n") % 4).alias("n")), 0.25)


def drawn_gaps(spark, d):
    """Cells of the suppliers' openings drawn as segments."""
    half = F.col("width") / 2
    s = O._gaps(spark, d).select("gap_id", (F.col("gx") - half * F.col("nz")).alias("x1"), (F.col("gz") + half * F.col("nx")).alias("z1"), (F.col("gx") + half * F.col("nz")).alias("x2"), (F.col("gz") - half * F.col("nx")).alias("z2"))
    return T.drawn(s, 0.3, 1, ("gap_id",))


def _runs(spark, d):
    c = PQ._cells(spark, d).groupBy("i", "j").agg(F.sum("l_quantity").cast("long").alias("q"))
    return c.withColumn("run", F.explode(F.array(*[F.lit(k) for k in range(3)]))).select("run", "i", "j", (F.floor(F.col("q") / (F.col("run") + 7)) % 3).alias("label"))


def consensus_edges(spark, d):
    """Neighbouring cells that most of three labellings put together."""
    e = T.consensus_edges(_runs(spark, d))
    split = lambda c: (F.shiftright(F.col(c), 32) - (1 << 30), F.col(c).bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 30))
    (ai, aj), (bi, bj) = split("x"), split("y")
    return e.select(ai.cast("long").alias("ai"), aj.alias("aj"), bi.cast("long").alias("bi"), bj.alias("bj"))


def best_shift(spark, d):
    i = table(spark, d, "lineitem").select((F.col("l_partkey") % 64).alias("i"), (F.col("l_suppkey") % 64).alias("j"), "l_returnflag", "l_linestatus")
    a, b = (i.where(F.col("l_returnflag") == f).groupBy("l_linestatus", "i", "j").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("l_linestatus", "i", "j") for f in "AR")
    return T.best_shift(a, b, 3, ("l_linestatus",)).select("l_linestatus", "di", "dj", "both", *_r(overlap=F.col("overlap")))


def sharpness(spark, d):
    i = table(spark, d, "lineitem").groupBy("l_returnflag", (F.col("l_partkey") % 64).alias("i"), (F.col("l_suppkey") % 64).alias("j")).agg(F.sum("l_quantity").alias("q"))
    return T.sharpness(i, ("l_returnflag",), "q").select("l_returnflag", "n", F.round("sharpness", 3).alias("sharpness"))


def covered_boxes(spark, d):
    return T.covered_boxes(_mask(spark, d), [0.0, 3.0, 5.5, 11.0, 16.0], [0.0, 2.5, 8.0, 16.0], 0.25, 0.3).select("x0", "z0", "x1", "z1", "n")


def outline(spark, d):
    return T.outline(_mask(spark, d))


def traced_areas(spark, d):
    """Areas of the traced borders by returns flag: rings around cells count for, rings around holes against."""
    i = table(spark, d, "lineitem").groupBy("l_returnflag", (F.col("l_partkey") % 64).alias("i"), (F.col("l_suppkey") % 64).alias("j")).agg(F.count(F.lit(1)).alias("n")).where("(n * 7 + i * 3 + j) % 5 < 3")
    rings = T.traced(T.outline(i, ("l_returnflag",)), ("l_returnflag",))
    areas = X.shoelace(rings, ("l_returnflag", "ring"), "k", "i", "j")
    return areas.groupBy("l_returnflag").agg(F.sum(F.when(F.col("ccw"), F.col("area")).otherwise(-F.col("area"))).alias("area"))


def smallest_rectangles(spark, d):
    p = Q._boxes(spark, d).select("p_brand", (F.col("x0") + F.col("z0") / 7).alias("x"), (F.col("z0") * 2 - F.col("x0") / 3).alias("z"))
    found = R.smallest_rectangle(p, ("p_brand",))
    return found.select("p_brand", R.room_kind(F.col("length"), F.col("width")).alias("kind"), F.round("length", 4).alias("length"), F.round("width", 4).alias("width"))


def _tree(spark, d):
    """Nations as a binary tree, each placed by its customers."""
    k = F.col("n_nationkey").cast("long")
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal") / 1000, 4).alias("t"), F.count(F.lit(1)).alias("n"))
    n = table(spark, d, "nation").join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(k.alias("b"), F.coalesce("t", F.lit(1.0)).alias("t"), F.coalesce("n", F.lit(0)).alias("n"))
    return n.where("b > 0").select(F.lit(0).alias("plan"), F.floor((F.col("b") - 1) / 2).alias("a"), "b", (F.col("b") % 4 * F.lit(1.5707963267948966) + 0.1).alias("yaw"), F.col("t").alias("tx"), (F.col("t") / 3).alias("tz"), F.lit(0.1).alias("sigma"), "n")


def chained_poses(spark, d):
    roots = spark.createDataFrame([(0, 0)], "plan int, room long")
    return L.chained_poses(_tree(spark, d), roots, "plan").select("room", "hops", *_r(yaw=F.col("yaw"), tx=F.col("tx"), tz=F.col("tz"), sigma=F.col("sigma")))


def link_edges(spark, d):
    """The strongest link between each two nations, with its sigma."""
    i = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    links = i.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("inliers"), F.round(F.avg("l_discount") * 40, 4).alias("yaw"), F.round(F.avg("l_quantity"), 4).alias("tx"))
    links = links.select(F.lit(0).alias("plan"), F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"), "yaw", "tx", F.lit(1.0).alias("tz"), "inliers", (F.col("c_nationkey") * 100 + F.col("s_nationkey")).alias("link"))
    rooms = table(spark, d, "nation").select(F.lit(0).alias("plan"), F.col("n_nationkey").alias("room"))
    return L.link_edges(links, rooms, "plan").select("a", "b", "inliers", *_r(yaw=F.col("yaw"), tx=F.col("tx"), sigma=F.col("sigma")))


def box_overlaps(spark, d):
    b = Q._boxes(spark, d).withColumnRenamed("p_partkey", "room")
    return L.overlaps(b, "p_brand", 0.5).select("p_brand", "a", "b", "area")


def placed_boxes(spark, d):
    b = Q._boxes(spark, d)
    poses = b.select("p_brand", "p_partkey", (F.col("p_partkey") % 4).cast("int").alias("turns"), (F.col("p_partkey") % 13 / 2.0).alias("tx"), (F.col("p_partkey") % 7 / 2.0).alias("tz"))
    return L.placed_boxes(b, poses, ("p_brand", "p_partkey")).select("p_partkey", "x0", "z0", "x1", "z1")


def pair_ratios(spark, d):
    i = table(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("zp"), (F.col("l_quantity") * 2000).alias("zb"))
    return Z.pair_ratios(i, ("l_suppkey",), 20).select("l_suppkey", "n", *_r(ratio=F.col("ratio")))


def similarity_fits(spark, d):
    """Embeddings of a label and themselves turned and moved: the similarity between both, with a quarter of wrong matches."""
    e = table(spark, d, "embeddings").select("label", "vec_id", *[F.col("embedding")[i].cast("double").alias(f"p{c}") for i, c in enumerate("xyz")])
    wrong = F.when(F.col("vec_id") % 4 == 3, 1.0).otherwise(0.0)
    pairs = e.select("label", "px", "py", "pz", (-F.col("pz") * 1.5 + 1 + wrong).alias("qx"), (F.col("py") * 1.5 - wrong).alias("qy"), (F.col("px") * 1.5 + 2).alias("qz"))
    found = Z.similarities(pairs, ("label",), thresh=0.05, iters=200, least=8)
    return found.select("label", "n", "inliers", F.round("s", 4).alias("s"), *[F.round(F.col("t")[k], 4).alias(f"t{c}") for k, c in enumerate("xyz")])


QUERIES = {f.__name__: f for f in (
    holes, interior, drawn_gaps, consensus_edges, best_shift, sharpness, covered_boxes, outline, traced_areas, smallest_rectangles, chained_poses, link_edges, box_overlaps, placed_boxes, pair_ratios, similarity_fits)}

_MASK = "g AS (SELECT l_partkey % 64 AS i, l_suppkey % 64 AS j, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT i, j FROM g WHERE (n * 7 + i * 3 + j) % 5 < 3)"
_TREE = """p AS (SELECT c_nationkey AS k, round(avg(c_acctbal) / 1000, 4) AS t FROM customer GROUP BY 1),
    e AS (SELECT CAST(n_nationkey AS BIGINT) AS b, (n_nationkey - 1) // 2 AS a, coalesce(t, 1.0::DOUBLE) AS t FROM nation LEFT JOIN p ON k = n_nationkey WHERE n_nationkey > 0)"""
_HALF = "1.5707963267948966::DOUBLE"

ORACLE_SQL = {
    "holes": f"""WITH RECURSIVE {_MASK}, x AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM c),
        e AS (SELECT i, j, i = i0 OR i = i1 OR j = j0 OR j = j1 AS edge FROM (SELECT unnest(range(i0, i1 + 1)) AS i FROM x), (SELECT unnest(range(j0, j1 + 1)) AS j FROM x), x WHERE (i, j) NOT IN (SELECT (i, j) FROM c)),
        r AS (SELECT i, j FROM e WHERE edge UNION SELECT e.i, e.j FROM r JOIN e ON abs(e.i - r.i) + abs(e.j - r.j) = 1)
        SELECT i, j FROM e WHERE (i, j) NOT IN (SELECT (i, j) FROM r)""",
    "interior": """WITH RECURSIVE g AS (SELECT l_partkey % 64 AS i, l_suppkey % 64 AS j, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT i, j FROM g WHERE (n + i) % 11 = 0), k AS (SELECT a, b FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)),
        s AS (SELECT i, j FROM g WHERE n % 2 = 0 OR n % 4 >= 2), d1 AS (SELECT DISTINCT i + a AS i, j + k.b AS j FROM s, k), d2 AS (SELECT DISTINCT i + a AS i, j + k.b AS j FROM d1, k),
        e1 AS (SELECT i - a AS i, j - k.b AS j FROM d2, k GROUP BY ALL HAVING count(*) = 9), e2 AS (SELECT i - a AS i, j - k.b AS j FROM e1, k GROUP BY ALL HAVING count(*) = 9),
        w AS (SELECT DISTINCT i + a AS i, j + k.b AS j FROM b, k WHERE abs(a) + abs(k.b) < 2), c AS (SELECT i, j FROM e2 WHERE (i, j) NOT IN (SELECT (i, j) FROM w)),
        x AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM c),
        e AS (SELECT i, j, (i + 10) * 1000 + j + 10 AS v, i = i0 OR i = i1 OR j = j0 OR j = j1 AS edge FROM (SELECT unnest(range(i0, i1 + 1)) AS i FROM x), (SELECT unnest(range(j0, j1 + 1)) AS j FROM x), x WHERE (i, j) NOT IN (SELECT (i, j) FROM c)),
        r AS (SELECT i, j FROM e WHERE edge UNION SELECT e.i, e.j FROM r JOIN e ON abs(e.i - r.i) + abs(e.j - r.j) = 1),
        h AS (SELECT i, j, v FROM e WHERE (i, j) NOT IN (SELECT (i, j) FROM r)), q AS (SELECT v, i, j FROM h UNION SELECT q.v, h.i, h.j FROM q JOIN h ON abs(h.i - q.i) + abs(h.j - q.j) = 1),
        m AS (SELECT v, count(*) AS n, avg(CASE WHEN b.i IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM q LEFT JOIN b ON b.i = q.i AND b.j = q.j GROUP BY v),
        f AS (SELECT i, j FROM c UNION SELECT i, j FROM h JOIN m ON m.v = h.v WHERE m.n < 96 AND m.share < 0.25), o AS (SELECT i - a AS i, j - k.b AS j FROM f, k GROUP BY ALL HAVING count(*) = 9)
        SELECT DISTINCT i + a AS i, j + k.b AS j FROM o, k""",
    "drawn_gaps": """WITH g AS (SELECT s_suppkey AS gap_id, s_acctbal / 2500 - 2 AS gx, (s_suppkey % 9) / 4.0::DOUBLE - 1 AS gz, ([1, 0, -1, 0]::DOUBLE[])[s_suppkey % 4 + 1] AS nx, ([0, 1, 0, -1]::DOUBLE[])[s_suppkey % 4 + 1] AS nz, (s_suppkey % 5) / 2.0::DOUBLE + 1 AS w FROM supplier),
        s AS (SELECT gap_id, gx - w / 2 * nz AS x1, gz + w / 2 * nx AS z1, gx + w / 2 * nz AS x2, gz - w / 2 * nx AS z2 FROM g), n AS (SELECT *, greatest(2, CAST(ceil(sqrt((x2 - x1) * (x2 - x1) + (z2 - z1) * (z2 - z1)) / (0.3::DOUBLE * 0.5::DOUBLE)) AS INTEGER)) AS n FROM s),
        k AS (SELECT *, unnest(range(n)) AS k FROM n), t AS (SELECT *, k / (n - 1) AS t FROM k), p AS (SELECT DISTINCT gap_id, CAST(floor((x1 + (x2 - x1) * t) / 0.3::DOUBLE) AS BIGINT) AS i, CAST(floor((z1 + (z2 - z1) * t) / 0.3::DOUBLE) AS BIGINT) AS j FROM t)
        SELECT DISTINCT gap_id, i + a AS i, j + b AS j FROM p, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)""",
    "consensus_edges": """WITH q AS (SELECT l_partkey % 64 AS i, l_suppkey % 64 AS j, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL), r AS (SELECT run, i, j, (q // (run + 7)) % 3 AS label FROM q, (SELECT unnest([0, 1, 2]) AS run)),
        p AS (SELECT a.i AS ai, a.j AS aj, b.i AS bi, b.j AS bj, a.label = b.label AS same FROM r a JOIN r b ON a.run = b.run AND ((b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1)))
        SELECT ai, aj, bi, bj FROM p GROUP BY ALL HAVING count_if(same) * 2 > count(*)""",
    "best_shift": """WITH c AS (SELECT l_linestatus, l_returnflag AS f, l_partkey % 64 AS i, l_suppkey % 64 AS j FROM lineitem GROUP BY ALL HAVING count(*) >= 2),
        v AS (SELECT a.l_linestatus, a.i - b.i AS di, a.j - b.j AS dj, count(*) AS both_ FROM c a JOIN c b ON a.f = 'A' AND b.f = 'R' AND a.l_linestatus = b.l_linestatus AND abs(a.i - b.i) <= 3 AND abs(a.j - b.j) <= 3 GROUP BY ALL),
        s AS (SELECT l_linestatus, count_if(f = 'A') AS na, count_if(f = 'R') AS nb FROM c GROUP BY 1)
        SELECT l_linestatus, CAST(di AS INTEGER) AS di, CAST(dj AS INTEGER) AS dj, both_ AS "both", round(both_ / least(na, nb), 6) AS overlap FROM v JOIN s USING (l_linestatus) QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY both_ DESC, abs(di) + abs(dj), di, dj) = 1""",
    "sharpness": """WITH p AS (SELECT l_returnflag AS f, l_partkey % 64 AS i, l_suppkey % 64 AS j, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
        l AS (SELECT c.f, a.q + b.q + d.q + e.q - 4 * c.q AS lap FROM p c JOIN p a ON a.f = c.f AND a.i = c.i - 1 AND a.j = c.j JOIN p b ON b.f = c.f AND b.i = c.i + 1 AND b.j = c.j JOIN p d ON d.f = c.f AND d.i = c.i AND d.j = c.j - 1 JOIN p e ON e.f = c.f AND e.i = c.i AND e.j = c.j + 1)
        SELECT f AS l_returnflag, count(*) AS n, round(var_pop(lap), 3) AS sharpness FROM l GROUP BY 1""",
    "covered_boxes": f"""WITH {_MASK}, s AS (SELECT (i + 0.5::DOUBLE) * 0.25::DOUBLE AS x, (j + 0.5::DOUBLE) * 0.25::DOUBLE AS z FROM c), a AS (SELECT unnest([0.0, 3.0, 5.5, 11.0]::DOUBLE[]) AS x0, unnest([3.0, 5.5, 11.0, 16.0]::DOUBLE[]) AS x1), b AS (SELECT unnest([0.0, 2.5, 8.0]::DOUBLE[]) AS z0, unnest([2.5, 8.0, 16.0]::DOUBLE[]) AS z1)
        SELECT x0, z0, x1, z1, count(*) AS n FROM a, b, s WHERE x >= x0 AND x < x1 AND z >= z0 AND z < z1 GROUP BY ALL HAVING count(*) * 0.25 * 0.25 >= (x1 - x0) * (z1 - z0) * 0.3""",
    "outline": f"""WITH {_MASK}, s AS (SELECT unnest([0, 1, 0, -1]) AS ni, unnest([-1, 0, 1, 0]) AS nj, unnest([0, 1, 1, 0]) AS a, unnest([0, 0, 1, 1]) AS b, unnest([1, 1, 0, 0]) AS d, unnest([0, 1, 1, 0]) AS e)
        SELECT i + a AS i1, j + b AS j1, i + d AS i2, j + e AS j2 FROM c, s WHERE (i + ni, j + nj) NOT IN (SELECT (i, j) FROM c)""",
    "traced_areas": "WITH g AS (SELECT l_returnflag, l_partkey % 64 AS i, l_suppkey % 64 AS j, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS area FROM g WHERE (n * 7 + i * 3 + j) % 5 < 3 GROUP BY 1",
    "smallest_rectangles": f"""WITH {Q._BOX}, p AS (SELECT p_brand, x0 + z0 / 7 AS x, z0 * 2 - x0 / 3 AS z FROM b), t AS (SELECT DISTINCT a.p_brand, round(atan2(b.z - a.z, b.x - a.x), 9) AS t FROM p a JOIN p b ON a.p_brand = b.p_brand AND (a.x < b.x OR (a.x = b.x AND a.z < b.z))),
        s AS (SELECT p_brand, t, max(x * cos(t) + z * sin(t)) - min(x * cos(t) + z * sin(t)) AS l, max(z * cos(t) - x * sin(t)) - min(z * cos(t) - x * sin(t)) AS w FROM p JOIN t USING (p_brand) GROUP BY ALL),
        m AS (SELECT p_brand, greatest(l, w) AS l, least(l, w) AS w FROM s QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY s.l * s.w, t) = 1)
        SELECT p_brand, CASE WHEN l / greatest(w, 0.000001) > 2.2 AND w < 1.6 THEN 'connector' ELSE 'room' END AS kind, round(l, 4) AS length, round(w, 4) AS width FROM m""",
    "chained_poses": f"""WITH RECURSIVE {_TREE}, r AS (SELECT 0::BIGINT AS room, 0 AS hops, 0.0::DOUBLE AS yaw, 0.0::DOUBLE AS tx, 0.0::DOUBLE AS tz, 0.0::DOUBLE AS s
            UNION ALL SELECT e.b, hops + 1, round_even((yaw + (e.b % 4 * {_HALF} + 0.1::DOUBLE)) / {_HALF}, 0) * {_HALF}, cos(yaw) * t - sin(yaw) * (t / 3) + tx, sin(yaw) * t + cos(yaw) * (t / 3) + tz, sqrt(s * s + 0.1::DOUBLE * 0.1::DOUBLE) FROM r JOIN e ON e.a = r.room)
        SELECT room, hops, round(r.yaw, 6) AS yaw, round(r.tx, 6) AS tx, round(r.tz, 6) AS tz, round(s, 6) AS sigma FROM r""",
    "link_edges": f"""WITH l AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS inliers, round(avg(l_discount) * 40, 4) AS yaw, round(avg(l_quantity), 4) AS tx FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
        SELECT a, b, inliers, round(round_even(l.yaw / {_HALF}, 0) * {_HALF}, 6) AS yaw, round(l.tx, 6) AS tx, round(greatest(0.03::DOUBLE, 0.5::DOUBLE / sqrt(inliers)), 6) AS sigma FROM l WHERE a <> b QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY inliers DESC, a * 100 + b) = 1""",
    "box_overlaps": f"""WITH {Q._BOX} SELECT p.p_brand, p.p_partkey AS a, q.p_partkey AS b, (least(p.x1, q.x1) - greatest(p.x0, q.x0)) * (least(p.z1, q.z1) - greatest(p.z0, q.z0)) AS area FROM b p JOIN b q ON p.p_brand = q.p_brand AND p.p_partkey < q.p_partkey
        WHERE least(p.x1, q.x1) - greatest(p.x0, q.x0) > 0.5 AND least(p.z1, q.z1) - greatest(p.z0, q.z0) > 0.5""",
    "placed_boxes": f"""WITH {Q._BOX}, t AS (SELECT *, p_partkey % 4 AS k, (p_partkey % 13) / 2.0::DOUBLE AS tx, (p_partkey % 7) / 2.0::DOUBLE AS tz FROM b),
        m AS (SELECT p_partkey, tx, tz, CASE k WHEN 0 THEN x0 WHEN 1 THEN -z0 WHEN 2 THEN -x0 ELSE z0 END AS ax, CASE k WHEN 0 THEN z0 WHEN 1 THEN x0 WHEN 2 THEN -z0 ELSE -x0 END AS az, CASE k WHEN 0 THEN x1 WHEN 1 THEN -z1 WHEN 2 THEN -x1 ELSE z1 END AS bx, CASE k WHEN 0 THEN z1 WHEN 1 THEN x1 WHEN 2 THEN -z1 ELSE -x1 END AS bz FROM t)
        SELECT p_partkey, least(ax, bx) + tx AS x0, least(az, bz) + tz AS z0, greatest(ax, bx) + tx AS x1, greatest(az, bz) + tz AS z1 FROM m""",
    "pair_ratios": "SELECT l_suppkey, count(*) AS n, round(quantile_cont(l_extendedprice / greatest(l_quantity * 2000, 0.001), 0.5), 6) AS ratio FROM lineitem WHERE l_extendedprice / greatest(l_quantity * 2000, 0.001) > 0.5 AND l_extendedprice / greatest(l_quantity * 2000, 0.001) < 2.0 GROUP BY 1 HAVING count(*) >= 20",
    "similarity_fits": "SELECT label, CAST(count(*) AS INTEGER) AS n, CAST(count_if(vec_id % 4 <> 3) AS INTEGER) AS inliers, 1.5::DOUBLE AS s, 1.0::DOUBLE AS tx, 0.0::DOUBLE AS ty, 2.0::DOUBLE AS tz FROM embeddings GROUP BY 1 HAVING count_if(vec_id % 4 <> 3) >= 8",
}
