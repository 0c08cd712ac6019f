"""Queries on points, levels and grids, bound to `embeddings`, `events` and `lineitem`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measure as M
from ..operators import grids as G
from ..operators import histograms as H
from ..operators import points as P
from ..operators.quantiles import exact_percentiles
from ..plans import levels as L
from ..session import table


def _points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(["x", "y", "z", "a", "b", "c"])])
    size = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    return e.select("vec_id", "x", "y", "z", (F.col("a") / size).alias("nx"), (F.col("b") / size).alias("ny"), (F.col("c") / size).alias("nz"))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", (F.col("l_extendedprice") / 10000).alias("x"), F.col("l_quantity").alias("y"), (F.col("l_discount") * 100).alias("z"), "l_tax")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 64).alias("i"), (F.col("l_suppkey") % 64).alias("j"), "l_quantity", "l_discount", "l_tax")


def _r(**columns) -> list:
    return [F.round(v, 6).alias(k) for k, v in columns.items()]


def voxel_downsample(spark, d):
    v = P.voxel_downsample(_points(spark, d), ("x", "y", "z"), 0.1, ("ny",))
    return v.select("vx", "vy", "vz", "n", *_r(x=F.col("x"), y=F.col("y"), z=F.col("z"), ny=F.col("ny")))


def voxel_downsample_lineitem(spark, d):
    v = P.voxel_downsample(_measured(spark, d), ("x", "y", "z"), 0.5, ("l_tax",))
    return v.select("vx", "vy", "vz", "n", *[F.round(c, 10).alias(c) for c in ("x", "y", "z", "l_tax")])


def dominant_yaw(spark, d):
    return P.dominant_yaw(_points(spark, d), "nx", "ny", "nz").select("n", *_r(yaw=F.col("yaw"), score=F.col("score")))


def rotate_to_walls(spark, d):
    """Points turned by the dominant yaw and their box, per label."""
    yaw = P.dominant_yaw(_points(spark, d), "nx", "ny", "nz").select(F.lit(0).alias("k"), F.cos(-F.col("yaw")).alias("c"), F.sin(-F.col("yaw")).alias("s"))
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = yaw.select("k", F.array(F.col("c"), zero, -F.col("s"), zero, zero, one, zero, zero, F.col("s"), zero, F.col("c"), zero, zero, zero, zero, one).alias("pose"))
    moved = P.transform_points(_points(spark, d).withColumn("k", F.lit(0)), pose, "k")
    return moved.select("vec_id", *_r(x=F.col("x"), y=F.col("y"), z=F.col("z")))


def grid_count(spark, d):
    return P.grid_count(_measured(spark, d), "x", "z", 0.5)


def slab_barrier(spark, d):
    p = P.cells(_measured(spark, d), "x", "z", 1.0)
    return P.slab_barrier(p, ("i", "j"), F.col("y"), [0.5, 10.5, 20.5, 30.5, 40.5, 50.5], (20.5, 35.5))


def semi_on_barrier(spark, d):
    """Rows whose cell blocks: a left semi join on the cell."""
    p = P.cells(_measured(spark, d), "x", "z", 1.0)
    barrier = P.slab_barrier(p, ("i", "j"), F.col("y"), [0.5, 10.5, 20.5, 30.5, 40.5, 50.5], (20.5, 35.5)).where("barrier")
    return p.join(barrier, ["i", "j"], "left_semi").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def ray_carve(spark, d):
    rays = table(spark, d, "embeddings").select(*[F.round(F.col("embedding")[i].cast("double"), 3).alias(n) for i, n in enumerate(["cx", "cz", "hx", "hz"])])
    return P.ray_carve(rays, ("cx", "cz"), ("hx", "hz"), 0.05, short=0.01)


def level_peaks(spark, d):
    return L.level_peaks(table(spark, d, "events").select("value"), "value", 2.0, anchor=0.0).select("bin", *_r(level=F.col("level"), s=F.col("s")))


def lowest_level(spark, d):
    return L.lowest_level(table(spark, d, "events").select("value"), "value", 2.0, 4.0, anchor=0.0)


def lowest_and_highest(spark, d):
    found = L.level_peaks(table(spark, d, "events").select("value"), "value", 2.0, anchor=0.0)
    return L.lowest_and_highest(found, share=0.05).select(*_r(floor=F.col("floor"), ceiling=F.col("ceiling")))


def robust_level(spark, d):
    e = table(spark, d, "events").select("event_type", "value").withColumn("guess", F.lit(20.0))
    return H.robust_level(e, "value", "guess", 15.0, keys=("event_type",)).select("event_type", "n", *_r(level=F.col("level"), sd=F.col("sd")))


def mad_sigma(spark, d):
    return H.mad_sigma(table(spark, d, "lineitem"), "l_extendedprice", ("l_returnflag", "l_linestatus")).select("l_returnflag", "l_linestatus", *_r(med=F.col("med"), mad_sigma=F.col("mad_sigma")))


def percentiles(spark, d):
    shares = {"p0_1": 0.001, "p3": 0.03, "p5": 0.05, "p90": 0.9, "p95": 0.95, "p98": 0.98, "p99_9": 0.999}
    found = exact_percentiles(table(spark, d, "lineitem"), ("l_returnflag",), "l_extendedprice", list(shares.values()))
    return found.select("l_returnflag", *[F.round(F.col("p")[i], 4).alias(k) for i, k in enumerate(shares)])


def coverage_bins(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / 1000).alias("t"))
    return H.coverage(o, "t", F.lit(1.0), F.lit(400.0), ("o_orderpriority",), 0.5).select("o_orderpriority", *_r(coverage=F.col("coverage")))


def otsu_threshold(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.floor("value").alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return H.otsu(e, ("event_type",)).select("event_type", "threshold", *_r(between=F.col("between")))


def measurement_algebra(spark, d):
    """Lengths with a budget of error terms, summed for each order status with independent errors."""
    i = table(spark, d, "lineitem")
    m = i.select("l_returnflag", "l_linestatus", M.length(F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"), F.lit(0.002)).alias("m"))
    value, sigma = M.summed(F.col("m.value"), F.col("m.sigma"), 1.3)
    return m.groupBy("l_returnflag", "l_linestatus").agg(F.round(value, 2).alias("value"), F.round(sigma, 3).alias("sigma"), F.round(F.max(F.col("m.budget")["scale"]), 4).alias("scale"))


def wall_area(spark, d):
    i = table(spark, d, "lineitem")
    m = i.select("l_orderkey", "l_linenumber", M.product(F.col("l_quantity"), F.col("l_tax") + 0.1, F.col("l_extendedprice"), F.col("l_discount") + 0.1).alias("m"))
    lo, hi = M.ci95(F.col("m"))
    return m.select("l_orderkey", "l_linenumber", F.round("m.value", 2).alias("value"), F.round("m.sigma", 4).alias("sigma"), F.round(lo, 3).alias("lo"), F.round(hi, 3).alias("hi"))


def se2_compose(spark, d):
    e = table(spark, d, "events").select("event_id", "value", (F.col("event_id") % 7).cast("double").alias("k"))
    yaw, tx, tz = M.se2_compose(F.col("value") / 100, F.col("k"), F.lit(1.0), F.col("k") / 3, F.col("value") / 10, F.col("k"))
    iy, ix, iz = M.se2_invert(F.col("value") / 100, F.col("k"), F.lit(1.0))
    return e.select("event_id", *_r(yaw=yaw, tx=tx, tz=tz, iy=iy, ix=ix, iz=iz), F.round(M.snap90(F.col("value") / 7), 6).alias("snap"))


def morphology(spark, d):
    """Cells with many rows, closed and then opened: their number at each step."""
    c = _cells(spark, d).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("i", "j")
    steps = {"raw": c, "dilated": G.dilate(c), "eroded": G.erode(c), "closed": G.closed(c), "opened": G.opened(c, G.CROSS)}
    out = None
    for name, cells in steps.items():
        row = cells.agg(F.lit(name).alias("step"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("i") * 64 + F.col("j")), F.lit(0)).alias("s"))
        out = row if out is None else out.unionByName(row)
    return out


def boundary_lengths(spark, d):
    c = _cells(spark, d).groupBy("i", "j").agg((F.sum("l_quantity").cast("long") % 5).alias("label"))
    return G.boundary_lengths(c)


def label_components(spark, d):
    c = _cells(spark, d).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).where("(n * 7 + i * 3 + j) % 5 < 3").select("i", "j")
    return G.label_components(c)


def window_mode(spark, d):
    """The mode around every cell."""
    c = _cells(spark, d).groupBy("i", "j").agg((F.sum("l_quantity").cast("long") % 5).alias("label"))
    return G.window_mode(c, c)


QUERIES = {f.__name__: f for f in (
    voxel_downsample, voxel_downsample_lineitem, dominant_yaw, rotate_to_walls, grid_count, slab_barrier, semi_on_barrier, ray_carve, level_peaks, lowest_level, lowest_and_highest, robust_level,
    mad_sigma, percentiles, coverage_bins, otsu_threshold, measurement_algebra, wall_area, se2_compose, morphology, boundary_lengths, label_components, window_mode)}

_POINTS = """
    e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
                 CAST(embedding[4] AS DOUBLE) AS a, CAST(embedding[5] AS DOUBLE) AS b, CAST(embedding[6] AS DOUBLE) AS c FROM embeddings),
    p AS (SELECT vec_id, x, y, z, a / sqrt(a * a + b * b + c * c) AS nx, b / sqrt(a * a + b * b + c * c) AS ny, c / sqrt(a * a + b * b + c * c) AS nz FROM e)"""
_MEASURED = "m AS (SELECT l_returnflag, l_extendedprice / 10000 AS x, l_quantity AS y, l_discount * 100 AS z, l_tax FROM lineitem)"
_BARRIER = """
    c AS (SELECT *, CAST(floor(x / 1.0::DOUBLE) AS BIGINT) AS i, CAST(floor(z / 1.0::DOUBLE) AS BIGINT) AS j FROM m),
    s AS (SELECT i, j, CASE WHEN y > 0.5 AND y < 10.5 THEN 0 WHEN y > 10.5 AND y < 20.5 THEN 1 WHEN y > 20.5 AND y < 30.5 THEN 2 WHEN y > 30.5 AND y < 40.5 THEN 3
                 WHEN y > 40.5 AND y < 50.5 THEN 4 END AS slab, count(*) AS n, sum(CASE WHEN y > 20.5 AND y < 35.5 THEN 1 ELSE 0 END) AS top FROM c GROUP BY ALL),
    b AS (SELECT i, j, CAST(sum(top) AS BIGINT) AS wall_hi, CAST(sum(CASE WHEN slab IS NOT NULL AND n >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS slabs FROM s GROUP BY i, j)"""
_PEAKS = """
    h AS (SELECT CAST(floor(value / 2.0::DOUBLE) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1),
    r AS (SELECT unnest(range((SELECT min(bin) FROM h), (SELECT max(bin) FROM h) + 1)) AS bin),
    f AS (SELECT r.bin, coalesce(n, 0.0::DOUBLE) AS n FROM r LEFT JOIN h USING (bin)),
    k AS (SELECT bin, (coalesce(lag(n, 2) OVER w, 0) * 1.0::DOUBLE + coalesce(lag(n, 1) OVER w, 0) * 2.0::DOUBLE + n * 3.0::DOUBLE + coalesce(lead(n, 1) OVER w, 0) * 2.0::DOUBLE
                 + coalesce(lead(n, 2) OVER w, 0) * 1.0::DOUBLE) / 9.0::DOUBLE AS s FROM f WINDOW w AS (ORDER BY bin)),
    g AS (SELECT *, lag(s) OVER (ORDER BY bin) AS a, lead(s) OVER (ORDER BY bin) AS b FROM k),
    pk AS (SELECT bin, (bin + 0.5::DOUBLE) * 2.0::DOUBLE AS level, s FROM g WHERE s >= a AND s > b
           AND s > greatest(0.02::DOUBLE * (SELECT count(value) FROM events) / 5.0::DOUBLE, 20.0::DOUBLE))"""


def _robust(near: str, keys: str, window: float, least: int = 10) -> str:
    """Three rounds of clipping over a relation with (keys, v, g)."""
    on = " AND ".join(f"r.{k} = t.{k}" for k in keys.split(", "))
    parts = [f"nr AS ({near})", f"t0 AS (SELECT {keys}, quantile_cont(v, 0.5) AS m, count(*) AS n_near, max(g) AS g FROM nr GROUP BY {keys})"]
    for i in range(3):
        cols = ", ".join(f"r.{k}" for k in keys.split(", "))
        parts += [
            f"d{i} AS (SELECT {cols}, r.v, t.m, t.n_near, t.g FROM nr r JOIN t{i} t ON {on})",
            f"s{i} AS (SELECT {keys}, quantile_cont(abs(v - m), 0.5) * 1.4826::DOUBLE + 0.0001::DOUBLE AS s FROM d{i} GROUP BY {keys})",
            f"t{i + 1} AS (SELECT {cols}, avg(r.v) AS m, stddev_pop(r.v) AS sd, count(*) AS n, max(r.n_near) AS n_near, max(r.g) AS g FROM d{i} r JOIN s{i} t ON {on} WHERE abs(r.v - r.m) < t.s * 2.5::DOUBLE GROUP BY {cols})",
        ]
    return ",\n".join(parts) + f""",
    lv AS (SELECT {keys}, CASE WHEN n_near < {least} THEN g ELSE m END AS level, CASE WHEN n_near < {least} THEN {window}::DOUBLE ELSE sd END AS sd, CASE WHEN n_near < {least} THEN n_near ELSE n END AS n FROM t3)"""


_MORPH = """c AS (SELECT l_partkey % 64 AS i, l_suppkey % 64 AS j FROM lineitem GROUP BY ALL HAVING count(*) >= 3),
    x AS (SELECT unnest([0, 1, -1, 0, 0]) AS a, unnest([0, 0, 0, 1, -1]) AS b),
    q AS (SELECT a, b FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)),
    dl AS (SELECT DISTINCT i + a AS i, j + b AS j FROM c, x),
    er AS (SELECT i - a AS i, j - b AS j FROM c, x GROUP BY ALL HAVING count(*) = 5),
    d9 AS (SELECT DISTINCT i + a AS i, j + b AS j FROM c, q),
    cl AS (SELECT i - a AS i, j - b AS j FROM d9, q GROUP BY ALL HAVING count(*) = 9),
    op AS (SELECT DISTINCT i + a AS i, j + b AS j FROM er, x)"""
_LABELS = "c AS (SELECT l_partkey % 64 AS i, l_suppkey % 64 AS j, CAST(sum(l_quantity) AS BIGINT) % 5 AS label FROM lineitem GROUP BY ALL)"

ORACLE_SQL = {
    "voxel_downsample": f"""WITH {_POINTS}
        SELECT CAST(floor(x / 0.1::DOUBLE) AS BIGINT) AS vx, CAST(floor(y / 0.1::DOUBLE) AS BIGINT) AS vy, CAST(floor(z / 0.1::DOUBLE) AS BIGINT) AS vz, count(*) AS n,
               round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(ny), 6) AS ny FROM p GROUP BY 1, 2, 3""",
    "voxel_downsample_lineitem": f"""WITH {_MEASURED}
        SELECT CAST(floor(x / 0.5::DOUBLE) AS BIGINT) AS vx, CAST(floor(y / 0.5::DOUBLE) AS BIGINT) AS vy, CAST(floor(z / 0.5::DOUBLE) AS BIGINT) AS vz, count(*) AS n,
               round(avg(x), 10) AS x, round(avg(y), 10) AS y, round(avg(z), 10) AS z, round(avg(l_tax), 10) AS l_tax FROM m GROUP BY 1, 2, 3""",
    "dominant_yaw": f"""WITH {_POINTS}, t AS (SELECT sum(cos(atan2(nz, nx) * 4)) AS c, sum(sin(atan2(nz, nx) * 4)) AS s, count(*) AS n FROM p WHERE abs(ny) < 0.2)
        SELECT n, round(atan2(s, c) / 4, 6) AS yaw, round(sqrt(c * c + s * s) / n, 6) AS score FROM t""",
    "rotate_to_walls": f"""WITH {_POINTS}, t AS (SELECT atan2(sum(sin(atan2(nz, nx) * 4)), sum(cos(atan2(nz, nx) * 4))) / 4 AS yaw FROM p WHERE abs(ny) < 0.2)
        SELECT vec_id, round(cos(-yaw) * x - sin(-yaw) * z, 6) AS x, round(y, 6) AS y, round(sin(-yaw) * x + cos(-yaw) * z, 6) AS z FROM p, t""",
    "grid_count": f"WITH {_MEASURED} SELECT CAST(floor(x / 0.5::DOUBLE) AS BIGINT) AS i, CAST(floor(z / 0.5::DOUBLE) AS BIGINT) AS j, count(*) AS n FROM m GROUP BY 1, 2",
    "slab_barrier": f"WITH {_MEASURED}, {_BARRIER} SELECT *, wall_hi >= 3 OR slabs >= 3 AS barrier FROM b",
    "semi_on_barrier": f"WITH {_MEASURED}, {_BARRIER} SELECT l_returnflag, count(*) AS n FROM c WHERE (i, j) IN (SELECT (i, j) FROM b WHERE wall_hi >= 3 OR slabs >= 3) GROUP BY 1",
    "ray_carve": """WITH r AS (SELECT round(CAST(embedding[1] AS DOUBLE), 3) AS cx, round(CAST(embedding[2] AS DOUBLE), 3) AS cz, round(CAST(embedding[3] AS DOUBLE), 3) AS hx, round(CAST(embedding[4] AS DOUBLE), 3) AS hz FROM embeddings),
        l AS (SELECT *, sqrt((hx - cx) * (hx - cx) + (hz - cz) * (hz - cz)) AS len FROM r),
        n AS (SELECT *, CAST(ceil(len / (0.8::DOUBLE * 0.05::DOUBLE)) AS INTEGER) AS n FROM l WHERE len > 0.1::DOUBLE),
        k AS (SELECT *, unnest(range(n)) AS k FROM n),
        t AS (SELECT *, k / n * (len - 0.01::DOUBLE) / len AS t FROM k)
        SELECT CAST(floor((cx + t * (hx - cx)) / 0.05::DOUBLE) AS BIGINT) AS i, CAST(floor((cz + t * (hz - cz)) / 0.05::DOUBLE) AS BIGINT) AS j, count(*) AS n FROM t GROUP BY 1, 2""",
    "level_peaks": f"WITH {_PEAKS} SELECT bin, round(level, 6) AS level, round(s, 6) AS s FROM pk",
    "lowest_level": f"""WITH {_PEAKS}, gs AS (SELECT min(level) AS guess FROM pk WHERE s > (SELECT max(s) FROM pk) * 0.25::DOUBLE),
        {_robust("SELECT 0 AS k0, value AS v, guess AS g FROM events, gs WHERE abs(value - guess) < 4.0::DOUBLE", "k0", 4.0)},
        z AS (SELECT level, n, sqrt(power(sd / sqrt(least(greatest(n / 25.0::DOUBLE, 1.0::DOUBLE), 400.0::DOUBLE)), 2) + power(0.004::DOUBLE, 2)) AS sigma FROM lv)
        SELECT round(level, 6) AS value, round(sigma, 6) AS sigma, round(level - sigma * 1.959964::DOUBLE, 6) AS ci_lo, round(level + sigma * 1.959964::DOUBLE, 6) AS ci_hi, 'm' AS unit, n FROM z""",
    "lowest_and_highest": f"""WITH {_PEAKS}, e AS (SELECT min(level) AS floor, max(level) AS top FROM pk WHERE s > (SELECT max(s) FROM pk) * 0.05::DOUBLE)
        SELECT round(floor, 6) AS floor, round(CASE WHEN top - floor > 1.9 THEN top END, 6) AS ceiling FROM e""",
    "robust_level": f"""WITH {_robust("SELECT event_type, value AS v, 20.0::DOUBLE AS g FROM events WHERE abs(value - 20.0::DOUBLE) < 15.0::DOUBLE", "event_type", 15.0)}
        SELECT event_type, n, round(level, 6) AS level, round(sd, 6) AS sd FROM lv""",
    "mad_sigma": """WITH m AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.5) AS med FROM lineitem GROUP BY ALL)
        SELECT l_returnflag, l_linestatus, round(med, 6) AS med, round(quantile_cont(abs(l_extendedprice - med), 0.5) * 1.4826::DOUBLE, 6) AS mad_sigma FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY l_returnflag, l_linestatus, med""",
    "percentiles": "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS {k}" for k, q in {"p0_1": 0.001, "p3": 0.03, "p5": 0.05, "p90": 0.9, "p95": 0.95, "p98": 0.98, "p99_9": 0.999}.items()) + " FROM lineitem GROUP BY 1",
    "coverage_bins": """WITH t AS (SELECT o_orderpriority, o_totalprice / 1000 AS t FROM orders)
        SELECT o_orderpriority, round(count(DISTINCT least(floor((t - 1.0::DOUBLE) / 0.5::DOUBLE), 797)) / 798.0::DOUBLE, 6) AS coverage FROM t WHERE t >= 1 AND t <= 400 GROUP BY 1""",
    "otsu_threshold": """WITH h AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL),
        c AS (SELECT event_type, bin, sum(n) OVER u AS w0, sum(n * bin) OVER u AS m0, sum(n) OVER e AS w, sum(n * bin) OVER e AS m FROM h
              WINDOW u AS (PARTITION BY event_type ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), e AS (PARTITION BY event_type)),
        b AS (SELECT event_type, bin, round(w0 / w * ((w - w0) / w) * (m0 / w0 - (m - m0) / (w - w0)) * (m0 / w0 - (m - m0) / (w - w0)), 9) AS between_ FROM c WHERE w0 > 0 AND w - w0 > 0)
        SELECT event_type, bin AS threshold, round(between_, 6) AS "between" FROM b QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY between_ DESC, bin) = 1""",
    "measurement_algebra": """WITH m AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v, abs(l_extendedprice) * 0.002::DOUBLE AS sc, l_discount AS a, l_tax AS b FROM lineitem)
        SELECT l_returnflag, l_linestatus, round(sum(v) * 1.3::DOUBLE, 2) AS value, round(sqrt(sum(a * a + b * b + sc * sc)) * 1.3::DOUBLE, 3) AS sigma, round(max(sc), 4) AS scale FROM m GROUP BY 1, 2""",
    "wall_area": """WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS v, sqrt(power((l_tax + 0.1::DOUBLE) / greatest(l_quantity, 0.000001), 2) + power((l_discount + 0.1::DOUBLE) / greatest(l_extendedprice, 0.000001), 2)) AS rel FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(v, 2) AS value, round(v * rel, 4) AS sigma, round(v - v * rel * 1.959964::DOUBLE, 3) AS lo, round(v + v * rel * 1.959964::DOUBLE, 3) AS hi FROM m""",
    "se2_compose": """WITH e AS (SELECT event_id, value AS v, CAST(event_id % 7 AS DOUBLE) AS k FROM events)
        SELECT event_id, round(v / 100 + k / 3, 6) AS yaw, round(cos(v / 100) * (v / 10) - sin(v / 100) * k + k, 6) AS tx, round(sin(v / 100) * (v / 10) + cos(v / 100) * k + 1.0::DOUBLE, 6) AS tz,
               round(-(v / 100), 6) AS iy, round(-(cos(v / 100) * k + sin(v / 100) * 1.0::DOUBLE), 6) AS ix, round(sin(v / 100) * k - cos(v / 100) * 1.0::DOUBLE, 6) AS iz,
               round(round_even(v / 7 / 1.5707963267948966::DOUBLE, 0) * 1.5707963267948966::DOUBLE, 6) AS snap FROM e""",
    "morphology": f"""WITH {_MORPH}
        SELECT step, count(i) AS n, CAST(coalesce(sum(i * 64 + j), 0) AS BIGINT) AS s FROM (
            SELECT 'raw' AS step, i, j FROM c UNION ALL SELECT 'dilated', i, j FROM dl UNION ALL SELECT 'eroded', i, j FROM er UNION ALL SELECT 'closed', i, j FROM cl UNION ALL SELECT 'opened', i, j FROM op
            UNION ALL SELECT unnest(['raw', 'dilated', 'eroded', 'closed', 'opened']), NULL, NULL) GROUP BY step""",
    "boundary_lengths": f"""WITH {_LABELS}, p AS (
            SELECT a.label AS la, b.label AS lb FROM c a JOIN c b ON b.i = a.i + 1 AND b.j = a.j WHERE a.label <> b.label
            UNION ALL SELECT a.label, b.label FROM c a JOIN c b ON b.i = a.i AND b.j = a.j + 1 WHERE a.label <> b.label)
        SELECT least(la, lb) AS a, greatest(la, lb) AS b, count(*) AS n FROM p GROUP BY 1, 2""",
    "label_components": """WITH RECURSIVE g AS (SELECT l_partkey % 64 AS i, l_suppkey % 64 AS j, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT i, j FROM g WHERE (n * 7 + i * 3 + j) % 5 < 3),
        n AS (SELECT i * 64 + j AS v, i, j FROM c),
        e AS (SELECT a.v AS a, b.v AS b FROM n a JOIN n b ON (abs(a.i - b.i) + abs(a.j - b.j)) = 1),
        r AS (SELECT v, v AS u FROM n UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
        m AS (SELECT v, min(u) AS f FROM r GROUP BY v)
        SELECT i, j, CAST(dense_rank() OVER (ORDER BY f) AS INTEGER) AS label FROM m JOIN n USING (v)""",
    "window_mode": f"""WITH {_LABELS}, v AS (SELECT a.i, a.j, b.label, count(*) AS n FROM c a JOIN c b ON abs(a.i - b.i) <= 3 AND abs(a.j - b.j) <= 3 GROUP BY ALL)
        SELECT i, j, label, n FROM v QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY n DESC, label) = 1""",
}
