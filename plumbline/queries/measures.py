"""Queries on measurements: sigmas by what was seen, priors, rounding, surfaces, directions, projections; bound to `lineitem`, `orders` and `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measure as M
from ..operators import geometry as X
from ..operators import points as P
from ..session import table
from . import points as PQ


def _r(**columns) -> list:
    return [F.round(v, 6).alias(k) for k, v in columns.items()]


def wall_states(spark, d):
    """Lines as wall planes: unseen, occluded or seen, with the sigma that follows, by state."""
    n, height, cover = F.col("l_partkey") % 900, F.col("l_quantity") / 20, F.col("l_discount") * 10
    i = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", M.plane_state(n, height).alias("state"), M.observed_sigma(F.col("l_tax") / 4, n, F.lit(0.004), height, cover, 0.05).alias("sigma"))
    return i.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sigma"), 6).alias("sigma"), F.round(F.max("sigma"), 6).alias("most"))


def ceiling_priors(spark, d):
    value, sigma = M.ceiling_prior(F.col("o_totalprice") / 90000, F.col("o_orderkey") % 120)
    return table(spark, d, "orders").select("o_orderkey", *_r(value=value, sigma=sigma))


def ceiling_heights(spark, d):
    """Heights between two fitted planes, with the budget of their sigmas."""
    o = table(spark, d, "orders").select("o_orderkey", M.ceiling_height(F.col("o_totalprice") / 50000 + 2, F.col("o_orderkey") % 50 / 1000.0, F.col("o_orderkey") % 3000, F.col("o_custkey") % 40 / 1000.0, F.col("o_custkey") % 900, F.lit(0.004), F.lit(0.002)).alias("m"))
    return o.select("o_orderkey", *_r(value=F.col("m.value"), sigma=F.col("m.sigma"), fit=F.col("m.budget")["fit"]))


def edge_sigmas(spark, d):
    """Sigmas of links, jambs and damage for each line."""
    i = table(spark, d, "lineitem")
    depth, edge = M.damage_sigmas(F.col("l_extendedprice") / 20000, F.col("l_quantity") / 10, F.col("l_quantity") / 12)
    return i.groupBy("l_returnflag", "l_linenumber").agg(
        F.round(F.avg(M.link_sigma(F.greatest(F.col("l_partkey") % 300, F.lit(1)))), 6).alias("link"), F.round(F.avg(M.jamb_sigma(F.col("l_tax"), F.col("l_partkey") % 500)), 6).alias("jamb"),
        F.round(F.avg(depth), 6).alias("depth"), F.round(F.avg(edge), 6).alias("edge"))


def area_measurements(spark, d):
    i = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("area"), F.sum(F.col("l_tax") * 100 + 1).alias("perimeter"), F.max("l_discount").alias("s"))
    m = i.select("l_orderkey", M.rounded(M.area(F.col("area"), F.col("perimeter"), F.col("s"), F.lit(0.002))).alias("m"))
    return m.select("l_orderkey", F.col("m.value").alias("value"), F.col("m.sigma").alias("sigma"), F.col("m.ci95")[0].alias("lo"), F.col("m.ci95")[1].alias("hi"))


def surface_areas(spark, d):
    """Areas of walls as length times height, of floors and ceilings as the room has it."""
    kind = F.when(F.col("l_linenumber") == 1, "floor").when(F.col("l_linenumber") == 2, "ceiling").otherwise("wall")
    value, sigma = M.surface_area(kind, F.col("l_quantity") / 10, F.col("l_tax") + 0.01, F.col("l_discount") + 2.4, F.lit(0.02), F.col("l_extendedprice") / 1000, F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("value"), F.round(F.sqrt(F.sum(sigma * sigma)), 6).alias("sigma"))


def published_units(spark, d):
    """Differences in millimetres and percent."""
    i = table(spark, d, "lineitem").select("l_returnflag", ((F.col("l_discount") - 0.053) / 7).alias("e"), (F.col("l_quantity") / 7).alias("l"))
    return i.groupBy("l_returnflag").agg(F.round(F.avg(M.millimetres(F.col("e"))), 3).alias("mm"), F.round(F.avg(M.percent(F.col("e"), F.col("l"))), 3).alias("pct"))


def height_bands(spark, d):
    """Points in the bands and orientations that maps are built from."""
    p = PQ._points(spark, d).select("*", (F.col("y") * 4 + 1).alias("h"))
    return P.band_counts(p, F.col("h"), F.col("ny"), F.lit(2.3))


def surface_coordinates(spark, d):
    kind = F.when(F.col("label") % 3 == 0, "floor").when(F.col("label") % 3 == 1, "ceiling").otherwise("wall")
    p = PQ._points(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    u, v = X.surface_uv(kind, F.col("x"), F.col("y"), F.col("z"), F.lit(0.6), F.lit(0.8), F.lit(0.1), F.lit(-0.2), F.lit(0.3))
    return p.select("vec_id", *_r(u=u, v=v))


def projected_points(spark, d):
    """Points seen by a pinhole camera; behind it none."""
    u, v = P.projected(F.col("x") + 0.1, F.col("y"), F.col("z"), F.lit(213.0), F.lit(213.0), F.lit(127.5), F.lit(95.5))
    return PQ._points(spark, d).select("vec_id", F.round(u, 3).alias("u"), F.round(v, 3).alias("v"))


def gravity(spark, d):
    """The direction that most normals share with up, found in ten steps, by label."""
    p = PQ._points(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    g = P.gravity(p, ("label",), steps=2, near=0.3)
    return g.select("label", "n", *_r(gx=F.col("gx"), gy=F.col("gy"), gz=F.col("gz")))


QUERIES = {f.__name__: f for f in (wall_states, ceiling_priors, ceiling_heights, edge_sigmas, area_measurements, surface_areas, published_units, height_bands, surface_coordinates, projected_points, gravity)}

_PLANE = "sqrt(power({sd} / sqrt(least(greatest({n} / 25.0::DOUBLE, 1.0::DOUBLE), 400.0::DOUBLE)), 2){more})"
_G = """p AS (SELECT e.label, p.* FROM p JOIN embeddings e USING (vec_id))"""

ORACLE_SQL = {
    "wall_states": """WITH i AS (SELECT l_partkey % 900 AS n, l_quantity / 20 AS h, l_discount * 10 AS cov, l_tax / 4 AS sd FROM lineitem),
        s AS (SELECT CASE WHEN n = 0 THEN 'unseen' WHEN h < 1.6::DOUBLE THEN 'occluded' ELSE 'wall' END AS state, cov, CASE WHEN n = 0 THEN sqrt(power(0.004::DOUBLE, 2) + power(0.3::DOUBLE, 2)) ELSE
            sqrt(power(sd / sqrt(least(greatest(n / 25.0::DOUBLE, 1.0::DOUBLE), 400.0::DOUBLE)), 2) + power(0.004::DOUBLE, 2) + CASE WHEN h < 1.6::DOUBLE THEN power(0.25::DOUBLE, 2) ELSE 0 END) END AS b FROM i),
        t AS (SELECT state, sqrt(b * b + power((1 - cov) * 0.05::DOUBLE, 2)) AS sigma FROM s) SELECT state, count(*) AS n, round(avg(t.sigma), 6) AS sigma, round(max(t.sigma), 6) AS most FROM t GROUP BY 1""",
    "ceiling_priors": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 120 <= 50 THEN 2.2::DOUBLE ELSE greatest(o_totalprice / 90000, 2.0::DOUBLE) END AS lb FROM orders)
        SELECT o_orderkey, round(greatest(lb, 2.5::DOUBLE), 6) AS value, round(greatest(0.15::DOUBLE, (3.2::DOUBLE - lb) / 3.92::DOUBLE), 6) AS sigma FROM o""",
    "ceiling_heights": f"""WITH o AS (SELECT o_orderkey, o_totalprice / 50000 + 2 AS h, {_PLANE.format(sd='((o_orderkey % 50) / 1000.0::DOUBLE)', n='(o_orderkey % 3000)', more='')} AS a, {_PLANE.format(sd='((o_custkey % 40) / 1000.0::DOUBLE)', n='(o_custkey % 900)', more='')} AS b FROM orders)
        SELECT o_orderkey, round(h, 6) AS value, round(sqrt(a * a + b * b + power(0.004::DOUBLE * sqrt(2.0::DOUBLE), 2) + power(h * 0.002::DOUBLE, 2)), 6) AS sigma, round(sqrt(a * a + b * b), 6) AS fit FROM o""",
    "edge_sigmas": """SELECT l_returnflag, l_linenumber, round(avg(greatest(0.03::DOUBLE, 0.5::DOUBLE / sqrt(greatest(l_partkey % 300, 1)))), 6) AS link,
            round(avg(sqrt(power(l_tax / sqrt(least(greatest((l_partkey % 500) / 10.0::DOUBLE, 1.0::DOUBLE), 200.0::DOUBLE)), 2) + power(0.003::DOUBLE, 2))), 6) AS jamb,
            round(avg(0.01::DOUBLE + 0.01::DOUBLE * (l_extendedprice / 20000)), 6) AS depth, round(avg(greatest(0.015::DOUBLE, 0.03::DOUBLE * least(l_quantity / 10, l_quantity / 12))), 6) AS edge FROM lineitem GROUP BY 1, 2""",
    "area_measurements": """WITH i AS (SELECT l_orderkey, sum(l_quantity) AS a, sum(l_tax * 100 + 1) AS p, max(l_discount) AS s FROM lineitem GROUP BY 1), m AS (SELECT l_orderkey, a, sqrt(power(p * s / sqrt(2.0::DOUBLE), 2) + power(a * 0.002::DOUBLE * 2, 2)) AS sg FROM i)
        SELECT l_orderkey, round(a, 4) AS value, round(sg, 5) AS sigma, round(a - sg * 1.959964::DOUBLE, 4) AS lo, round(a + sg * 1.959964::DOUBLE, 4) AS hi FROM m""",
    "surface_areas": """WITH i AS (SELECT CASE l_linenumber WHEN 1 THEN 'floor' WHEN 2 THEN 'ceiling' ELSE 'wall' END AS kind, l_quantity / 10 AS l, l_tax + 0.01::DOUBLE AS sl, l_discount + 2.4::DOUBLE AS h, l_extendedprice / 1000 AS ra, l_discount AS rs FROM lineitem),
        s AS (SELECT kind, CASE WHEN kind = 'wall' THEN l * h ELSE ra END AS v, CASE WHEN kind = 'wall' THEN l * h * sqrt(power(sl / greatest(l, 0.000001), 2) + power(0.02::DOUBLE / greatest(h, 0.000001), 2)) ELSE rs END AS s FROM i) SELECT kind, count(*) AS n, round(sum(v), 4) AS value, round(sqrt(sum(s * s)), 6) AS sigma FROM s GROUP BY 1""",
    "published_units": """WITH i AS (SELECT l_returnflag, (l_discount - 0.053::DOUBLE) / 7 AS e, l_quantity / 7 AS l FROM lineitem) SELECT l_returnflag, round(avg(round(e * 1000, 1)), 3) AS mm, round(avg(round(e / l * 100, 2)), 3) AS pct FROM i GROUP BY 1""",
    "height_bands": f"""WITH {PQ._POINTS}, h AS (SELECT ny, y * 4 + 1 AS h FROM p) SELECT CAST(count_if(abs(ny) < 0.3) AS BIGINT) AS vertical, CAST(count_if(ny > 0.85 AND abs(h) < 0.04) AS BIGINT) AS floor, CAST(count_if(ny < -0.85) AS BIGINT) AS ceiling, CAST(count_if(abs(ny) < 0.2) AS BIGINT) AS horizontal,
        CAST(count_if(abs(ny) < 0.3 AND h > 1.25 AND h < least(1.95::DOUBLE, 2.3::DOUBLE - 0.15::DOUBLE)) AS BIGINT) AS wall_hi, CAST(count_if(abs(ny) < 0.3 AND h > 0.1 AND h < 2.3::DOUBLE - 0.1::DOUBLE) AS BIGINT) AS wall_any FROM h""",
    "surface_coordinates": f"""WITH {PQ._POINTS}, {_G.replace('p AS', 'q AS')} SELECT vec_id, round(CASE WHEN label % 3 < 2 THEN x ELSE (x - 0.1::DOUBLE) * 0.6::DOUBLE + (z - 0.3::DOUBLE) * 0.8::DOUBLE END, 6) AS u, round(CASE WHEN label % 3 < 2 THEN z ELSE y + 0.2::DOUBLE END, 6) AS v FROM q""",
    "projected_points": f"""WITH {PQ._POINTS} SELECT vec_id, round(CASE WHEN z > 0.000001 THEN (x + 0.1::DOUBLE) / z * 213.0::DOUBLE + 127.5::DOUBLE END, 3) AS u, round(CASE WHEN z > 0.000001 THEN y / z * 213.0::DOUBLE + 95.5::DOUBLE END, 3) AS v FROM p""",
    "gravity": f"""WITH {PQ._POINTS}, {_G.replace('p AS', 'q AS')},
        a AS (SELECT label, sum(sign(ny) * nx) AS x, sum(sign(ny) * ny) AS y, sum(sign(ny) * nz) AS z, count(*) AS n FROM q WHERE abs(ny) > 0.3 GROUP BY 1), a1 AS (SELECT label, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM a),
        d AS (SELECT q.label, nx, ny, nz, nx * a1.x + ny * a1.y + nz * a1.z AS d FROM q JOIN a1 ON a1.label = q.label), b AS (SELECT label, sum(sign(d) * nx) AS x, sum(sign(d) * ny) AS y, sum(sign(d) * nz) AS z, count(*) AS n FROM d WHERE abs(d) > 0.3 GROUP BY 1)
        SELECT label, n, round(x / sqrt(x * x + y * y + z * z), 6) AS gx, round(y / sqrt(x * x + y * y + z * z), 6) AS gy, round(z / sqrt(x * x + y * y + z * z), 6) AS gz FROM b""",
}
