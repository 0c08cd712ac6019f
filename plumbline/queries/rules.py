"""Queries on rules, scope, calibration and documents, bound to `events`, `lineitem`, `orders`, `labels`, `documents` and `pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rules as R
from ..operators import statistics as S
from ..plans import documents as D
from ..session import table

#: How event types stand for damage classes and surface kinds here.
CLASSES = {"click": "water_stain", "view": "mould", "purchase": "crack", "signup": "peeling_paint", "logout": "hole_or_impact"}


def _regions(spark, d):
    """Events as damage regions: type is class, user a room, value size and place."""
    e = table(spark, d, "events")
    cls = F.element_at(F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv]), F.col("event_type"))
    n = F.col("event_id")
    kind = F.when(n % 5 == 0, "ceiling").when(n % 11 == 0, "floor").otherwise("wall")
    surface = F.concat(F.lit("r"), F.col("user_id").cast("string"), F.when(kind == "wall", F.concat(F.lit(".W"), (n % 4).cast("string"))).otherwise(F.concat(F.lit("."), kind)))
    return e.select(
        n.alias("id"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("room_id"), surface.alias("surface_id"), kind.alias("surface_kind"), F.coalesce(cls, F.lit("crack")).alias("cls"),
        (F.col("value") / 500).alias("width_m"), (F.col("value") / 400 - (n % 3) / 10.0).alias("height_m"), ((n % 25) / 10.0).alias("height_above_floor_m"),
        (2.5 - (n % 25) / 10.0).alias("dist_to_ceiling_m"), (n % 13 == 0).alias("is_exterior_wall"), ((n % 40) / 10.0).alias("wet_room_dist_m"), ((n % 17) / 10.0).alias("corner_dist_m"),
        (n % 9).cast("double").alias("cx"), (n % 7).cast("double").alias("cz"), (n % 19 == 0).alias("low_confidence"))


def region_rules(spark, d):
    return R.region_flags(_regions(spark, d), R.REGION_RULES).select("region_id", "surface_id", "rule", "severity")


def pair_rules(spark, d):
    """Pairs as the rule engine has them: of a room's first 400 regions."""
    return R.pair_flags(_regions(spark, d), R.PAIR_RULE, cell=0.75, most=R.ENGINE_MOST).select("room_id", "a_id", "b_id", "rule")


def pair_rules_all(spark, d):
    return R.pair_flags(_regions(spark, d), R.PAIR_RULE, cell=0.75).select("room_id", "a_id", "b_id", "rule")


def flag_numbers(spark, d):
    """Numbers of all flags."""
    return R.numbered_flags(R.region_flags(_regions(spark, d), R.REGION_RULES)).select("flag_id", "region_id", "rule")


def scope_items(spark, d):
    regions = _regions(spark, d).withColumn("area_m2", F.abs(F.col("width_m") * F.col("height_m"))).withColumn("sigma", F.col("width_m") * 0.03)
    surfaces = regions.groupBy("surface_id").agg(F.first("surface_kind").alias("kind"), (F.max("width_m") + 3).alias("length_m"), F.lit(2.4).alias("height"))
    items = R.scope_items(regions, surfaces, R.SCOPE_RULES)
    return items.select("code", "surface_id", "n", F.round("value", 7).alias("value"), F.round("sigma", 5).alias("sigma"), "unit")


def wall_statistics(spark, d):
    """Calibration of one measured length against another, per return flag."""
    i = table(spark, d, "lineitem").select("l_returnflag", ((F.col("l_discount") - 0.05) * 2 + F.col("l_tax") / 7).alias("diff"), (F.col("l_quantity") / 10 + 1).alias("length"), (F.col("l_tax") + 0.01).alias("sigma"))
    return S.wall_statistics(i, ("l_returnflag",), "diff", "length", "sigma", absolute=0.03, relative=0.02)


def opening_statistics(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("n_a"), F.count_if(F.col("o_orderstatus") == "F").alias("n_b"), F.count_if(F.col("o_orderkey") % 3 == 0).alias("hits"))
    return S.opening_score(o.withColumn("ok", F.least("n_a", "n_b", "hits")), "ok", "n_a", "n_b").select("o_custkey", F.round("score", 3).alias("score"))


def precision_recall(spark, d):
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    found = l.select(F.col("lang").alias("cls"), (F.col("quality") == 0).alias("truth"), (F.col("n_chars") % 3 == 0).alias("found"))
    return S.precision_recall(found, "cls", "truth", "found").select("cls", "n_truth", "n_found", "n_matched", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def operating_points(spark, d):
    """The threshold grid over labelled documents: false hits, recall and precision at each point."""
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    r = l.select((F.col("quality") == 0).alias("truth"), (F.col("n_chars") % 100 / 100.0).alias("score"), (F.col("doc_id") % 4).alias("views"), (F.col("n_chars") % 11 / 10.0).alias("consistency"), (F.col("n_chars") % 25).cast("double").alias("contrast"))
    return S.sweep(r, S.GRID).select("min_score", "min_views", "min_consistency", "min_contrast", "false_hits", "hits", F.round("recall", 6).alias("recall"))


def chosen_operating_point(spark, d):
    return S.choose(operating_points(spark, d), most_false=3)


def fused_clusters(spark, d):
    """Confidence and sizes of event clusters seen in several hours."""
    e = table(spark, d, "events")
    c = e.select("event_type", "user_id", F.hour("ts").alias("frame"), (F.col("value") / 500).alias("score"), (F.col("event_id") % 50).cast("double").alias("l"), (F.col("value") % 20).alias("a"), (F.col("value") / 9).alias("u"), (F.col("event_id") % 30).cast("double").alias("v"))
    f = S.fuse(c, ("event_type", "user_id"), "frame", "score", ("l", "a"), ("u", "v"))
    return f.select("event_type", "user_id", "n_views", *[F.round(x, 6).alias(x) for x in ("confidence", "spread", "width", "height", "width_sd")])


def plan_document(spark, d):
    """Orders with their lines as nested documents, checked and read back: one row of scalars each."""
    o, i = table(spark, d, "orders"), table(spark, d, "lineitem")
    docs = D.nested(o.select("o_orderkey", "o_orderstatus", "o_totalprice"), i.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), "o_orderkey", "l_orderkey", ["l_linenumber", "l_quantity", "l_tax"], "lines")
    text = docs.select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "lines")).alias("doc"))
    back = text.select("o_orderkey", F.from_json("doc", "o_totalprice double, lines array<struct<l_linenumber: int, l_quantity: double, l_tax: double>>").alias("p"))
    q = F.aggregate("p.lines", F.lit(0.0), lambda s, x: s + x["l_quantity"])
    return back.select("o_orderkey", F.round("p.o_totalprice", 2).alias("total"), F.size("p.lines").alias("n"), F.round(q, 2).alias("quantity"))


def document_violations(spark, d):
    """Violations of a published form by orders read as documents."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("value"), F.concat(F.lit("r"), F.col("o_custkey").cast("string"), F.lit(".W"), (F.col("o_orderkey") % 3).cast("string")).alias("wall"))
    checks = {"kind: not one of O, F": ~F.col("kind").isin("O", "F"), "value: above 300000": F.col("value") > 300000, "wall: bad id": ~F.col("wall").rlike(r"^[A-Za-z0-9_-]+\.W[0-1]$")}
    return D.violations(o, "id", checks).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


def fingerprints(spark, d):
    """One content hash for each host of pages, over names and sizes in order."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"), "page_id", F.length("html").alias("size"))
    return D.fingerprint(p, ("host",), F.col("page_id").cast("string"), F.col("size"))


def keyword_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", T.contains_any(F.col("text"), ["bath", "wc", "the "]).alias("wet"), T.slug(F.col("text")).alias("slug"))


QUERIES = {f.__name__: f for f in (
    region_rules, pair_rules, pair_rules_all, flag_numbers, scope_items, wall_statistics, opening_statistics, precision_recall, operating_points, chosen_operating_point, fused_clusters, plan_document, document_violations, fingerprints, keyword_flags)}

_REGIONS = """g AS (SELECT event_id AS id, 'r' || user_id AS room_id,
        CASE WHEN event_id % 5 = 0 THEN 'ceiling' WHEN event_id % 11 = 0 THEN 'floor' ELSE 'wall' END AS surface_kind,
        CASE event_type WHEN 'click' THEN 'water_stain' WHEN 'view' THEN 'mould' WHEN 'purchase' THEN 'crack' WHEN 'signup' THEN 'peeling_paint' WHEN 'logout' THEN 'hole_or_impact' ELSE 'crack' END AS cls,
        value / 500 AS width_m, value / 400 - (event_id % 3) / 10.0::DOUBLE AS height_m, (event_id % 25) / 10.0::DOUBLE AS height_above_floor_m, 2.5::DOUBLE - (event_id % 25) / 10.0::DOUBLE AS dist_to_ceiling_m,
        event_id % 13 = 0 AS is_exterior_wall, (event_id % 40) / 10.0::DOUBLE AS wet_room_dist_m, (event_id % 17) / 10.0::DOUBLE AS corner_dist_m, CAST(event_id % 9 AS DOUBLE) AS cx, CAST(event_id % 7 AS DOUBLE) AS cz, event_id % 19 = 0 AS low_confidence FROM events),
    r AS (SELECT *, room_id || CASE WHEN surface_kind = 'wall' THEN '.W' || (id % 4) ELSE '.' || surface_kind END AS surface_id FROM g)"""
_FLAGS = """f AS (
        SELECT id, surface_id, 1 AS o, 'ceiling_water_stain' AS rule, 'high' AS severity FROM r WHERE cls = 'water_stain' AND surface_kind = 'ceiling'
        UNION ALL SELECT id, surface_id, 2, 'wall_base_moisture', 'medium' FROM r WHERE cls IN ('water_stain', 'mould') AND surface_kind = 'wall' AND height_above_floor_m < 0.3::DOUBLE
        UNION ALL SELECT id, surface_id, 3, 'near_wet_room_moisture', 'medium' FROM r WHERE cls IN ('water_stain', 'mould') AND surface_kind = 'wall' AND wet_room_dist_m < 2.0
        UNION ALL SELECT id, surface_id, 4, 'exterior_wall_mould', 'medium' FROM r WHERE cls = 'mould' AND surface_kind = 'wall' AND is_exterior_wall
        UNION ALL SELECT id, surface_id, 5, 'structural_crack', 'high' FROM r WHERE cls = 'crack' AND ((surface_kind = 'wall' AND corner_dist_m < 0.5) OR greatest(width_m, height_m) > 0.5))"""
_SCORED = "l AS (SELECT quality = 0 AS truth, (n_chars % 100) / 100.0::DOUBLE AS score, doc_id % 4 AS views, (n_chars % 11) / 10.0::DOUBLE AS consistency, CAST(n_chars % 25 AS DOUBLE) AS contrast FROM labels JOIN documents USING (doc_id))"
_SWEEP = """g AS (SELECT s AS min_score, v AS min_views, c AS min_consistency, t AS min_contrast
            FROM (SELECT unnest([0.22, 0.24, 0.26, 0.28, 0.30, 0.32, 0.34, 0.36, 0.38, 0.40, 0.42, 0.46, 0.50]::DOUBLE[]) AS s), (SELECT unnest([1, 2, 3]) AS v),
                 (SELECT unnest([0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS c), (SELECT unnest([0, 3, 6, 9, 12, 15, 18, 22]::DOUBLE[]) AS t)),
    w AS (SELECT g.*, CAST(count_if(NOT truth AND score >= min_score AND views >= min_views AND consistency >= min_consistency AND contrast >= min_contrast) AS BIGINT) AS false_hits,
                 CAST(count_if(truth AND score >= min_score AND views >= min_views AND consistency >= min_consistency AND contrast >= min_contrast) AS BIGINT) AS hits, count_if(truth) AS n FROM g, l GROUP BY ALL),
    o AS (SELECT min_score, min_views, min_consistency, min_contrast, false_hits, hits, round(hits / n, 6) AS recall FROM w)"""

ORACLE_SQL = {
    "region_rules": f"WITH {_REGIONS}, {_FLAGS} SELECT id AS region_id, surface_id, rule, severity FROM f",
    "pair_rules": f"""WITH {_REGIONS}, s AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY id) AS k FROM r QUALIFY k <= 400)
        SELECT a.room_id, a.id AS a_id, b.id AS b_id, 'ceiling_wall_junction_stain' AS rule FROM s a JOIN s b ON a.room_id = b.room_id AND a.id < b.id
        WHERE a.cls = 'water_stain' AND b.cls = 'water_stain' AND ((a.surface_kind = 'ceiling' AND b.surface_kind = 'wall') OR (a.surface_kind = 'wall' AND b.surface_kind = 'ceiling'))
          AND sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cz - b.cz) * (a.cz - b.cz)) < 0.75
          AND ((a.surface_kind = 'wall' AND a.dist_to_ceiling_m < 0.4) OR (b.surface_kind = 'wall' AND b.dist_to_ceiling_m < 0.4))""",
    "pair_rules_all": f"""WITH {_REGIONS}, s AS (SELECT * FROM r)
        SELECT a.room_id, a.id AS a_id, b.id AS b_id, 'ceiling_wall_junction_stain' AS rule FROM s a JOIN s b ON a.room_id = b.room_id AND a.id < b.id
        WHERE a.cls = 'water_stain' AND b.cls = 'water_stain' AND ((a.surface_kind = 'ceiling' AND b.surface_kind = 'wall') OR (a.surface_kind = 'wall' AND b.surface_kind = 'ceiling'))
          AND sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cz - b.cz) * (a.cz - b.cz)) < 0.75
          AND ((a.surface_kind = 'wall' AND a.dist_to_ceiling_m < 0.4) OR (b.surface_kind = 'wall' AND b.dist_to_ceiling_m < 0.4))""",
    "flag_numbers": f"WITH {_REGIONS}, {_FLAGS} SELECT 'concealed.' || printf('%04d', row_number() OVER (ORDER BY id, o)) AS flag_id, id AS region_id, rule FROM f",
    "scope_items": f"""WITH {_REGIONS}, v AS (SELECT *, abs(width_m * height_m) AS area, width_m * 0.03::DOUBLE AS sg, greatest(width_m, height_m) AS len FROM r),
        u AS (SELECT surface_id, max(width_m) + 3 AS l, 2.4::DOUBLE AS h FROM v GROUP BY 1),
        m AS (SELECT * FROM v WHERE NOT low_confidence AND surface_kind IN ('wall', 'ceiling'))
        SELECT code, surface_id, n, round(value, 7) AS value, round(sigma, 5) AS sigma, unit FROM (
            SELECT '09.91-REPAINT-SURF' AS code, surface_id, count(*) AS n, max(l * h) AS value, max(l * h * sqrt(power(0.01::DOUBLE / greatest(l, 0.000001), 2) + power(0.02::DOUBLE / greatest(h, 0.000001), 2))) AS sigma, 'm2' AS unit FROM m JOIN u USING (surface_id) WHERE cls IN ('water_stain', 'mould') GROUP BY surface_id
            UNION ALL SELECT '01.74-MOLD-REMED', surface_id, count(*), sum(area) * 1.3::DOUBLE, sqrt(sum(sg * sg)) * 1.3::DOUBLE, 'm2' FROM m WHERE cls = 'mould' GROUP BY surface_id
            UNION ALL SELECT '09.21-CRACK-FILL', surface_id, count(*), sum(len), sqrt(sum(sg * sg)), 'm' FROM m WHERE cls = 'crack' GROUP BY surface_id
            UNION ALL SELECT '09.21-PATCH', surface_id, count(*), CAST(count(*) AS DOUBLE), 0.0::DOUBLE, 'ea' FROM m WHERE cls = 'hole_or_impact' AND surface_kind = 'wall' GROUP BY surface_id
            UNION ALL SELECT '09.91-PREP-REPAINT', surface_id, count(*), max(l * h), max(l * h * sqrt(power(0.01::DOUBLE / greatest(l, 0.000001), 2) + power(0.02::DOUBLE / greatest(h, 0.000001), 2))), 'm2' FROM m JOIN u USING (surface_id) WHERE cls = 'peeling_paint' GROUP BY surface_id)""",
    "wall_statistics": """WITH i AS (SELECT l_returnflag, (l_discount - 0.05::DOUBLE) * 2 + l_tax / 7 AS d, l_quantity / 10 + 1 AS len, l_tax + 0.01::DOUBLE AS s FROM lineitem)
        SELECT l_returnflag, count(*) AS n, round(quantile_cont(abs(d), 0.5) * 1000, 1) AS median_abs_mm, round(quantile_cont(abs(d), 0.9) * 1000, 1) AS p90_abs_mm, round(quantile_cont(abs(d) / len, 0.5) * 100, 2) AS median_abs_pct,
               round(sqrt(avg((d / s) * (d / s))), 2) AS z_rms, round(avg(CASE WHEN abs(d) <= 1.96::DOUBLE * s THEN 1.0::DOUBLE ELSE 0 END), 3) AS ci95_coverage,
               round(avg(CASE WHEN abs(d) <= 0.03::DOUBLE OR abs(d) <= 0.02::DOUBLE * len THEN 1.0::DOUBLE ELSE 0 END), 3) AS pass_rate FROM i GROUP BY 1""",
    "opening_statistics": """WITH o AS (SELECT o_custkey, count_if(o_orderstatus = 'O') AS a, count_if(o_orderstatus = 'F') AS b, count_if(o_orderkey % 3 = 0) AS h FROM orders GROUP BY 1)
        SELECT o_custkey, round(CASE WHEN greatest(a, b) > 0 THEN least(a, b, h) / greatest(a, b) END, 3) AS score FROM o""",
    "precision_recall": """WITH l AS (SELECT lang AS cls, quality = 0 AS t, n_chars % 3 = 0 AS f FROM labels JOIN documents USING (doc_id)),
        c AS (SELECT cls, CAST(count_if(t) AS BIGINT) AS n_truth, CAST(count_if(f) AS BIGINT) AS n_found, CAST(count_if(t AND f) AS BIGINT) AS n_matched FROM l GROUP BY 1)
        SELECT *, round(CASE WHEN n_found > 0 THEN n_matched / n_found END, 6) AS precision, round(CASE WHEN n_truth > 0 THEN n_matched / n_truth END, 6) AS recall FROM c""",
    "operating_points": f"WITH {_SCORED}, {_SWEEP} SELECT * FROM o",
    "chosen_operating_point": f"WITH {_SCORED}, {_SWEEP} SELECT * FROM o WHERE false_hits <= 3 ORDER BY recall DESC, false_hits, min_score, min_views, min_consistency, min_contrast LIMIT 1",
    "fused_clusters": """WITH c AS (SELECT event_type, user_id, hour(ts) AS frame, value / 500 AS score, CAST(event_id % 50 AS DOUBLE) AS l, value % 20 AS a, value / 9 AS u, CAST(event_id % 30 AS DOUBLE) AS v FROM events),
        m AS (SELECT event_type, user_id, count(DISTINCT frame) AS n_views, avg(score) AS score, avg(l) AS ml, avg(a) AS ma, max(u) - min(u) AS width, max(v) - min(v) AS height FROM c GROUP BY ALL),
        s AS (SELECT event_type, user_id, avg(sqrt((l - ml) * (l - ml) + (a - ma) * (a - ma))) AS spread FROM c JOIN m USING (event_type, user_id) GROUP BY ALL),
        f AS (SELECT event_type, user_id, frame, max(u) - min(u) AS w FROM c GROUP BY ALL), w AS (SELECT event_type, user_id, stddev_pop(w) AS width_sd FROM f GROUP BY ALL)
        SELECT event_type, user_id, n_views, round(least(greatest(0.5::DOUBLE * score + 0.3::DOUBLE * least(n_views / 2.0::DOUBLE, 1.0::DOUBLE) + 0.2::DOUBLE * exp(-spread / 18.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) * CASE WHEN n_views < 2 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END, 6) AS confidence,
               round(spread, 6) AS spread, round(width, 6) AS width, round(height, 6) AS height, round(width_sd, 6) AS width_sd FROM m JOIN s USING (event_type, user_id) JOIN w USING (event_type, user_id)""",
    "plan_document": "SELECT o_orderkey, round(max(o_totalprice), 2) AS total, CAST(count(l_orderkey) AS INTEGER) AS n, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "document_violations": """SELECT message, count(*) AS n FROM (
        SELECT 'kind: not one of O, F' AS message FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 'value: above 300000' FROM orders WHERE o_totalprice > 300000
        UNION ALL SELECT 'wall: bad id' FROM orders WHERE o_orderkey % 3 = 2) GROUP BY 1""",
    "fingerprints": """SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, sha1(string_agg(page_id || ':' || length(html), '' ORDER BY CAST(page_id AS VARCHAR))) AS fingerprint FROM pages GROUP BY 1""",
    "keyword_flags": """SELECT doc_id, contains(lower(text), 'bath') OR contains(lower(text), 'wc') OR contains(lower(text), 'the ') AS wet,
        CASE WHEN trim(lower(regexp_replace(text, '[^A-Za-z0-9]', '_', 'g')), '_') = '' THEN 'room' ELSE trim(lower(regexp_replace(text, '[^A-Za-z0-9]', '_', 'g')), '_') END AS slug FROM documents""",
}
