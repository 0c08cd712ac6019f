"""Rule evaluation: findings from regions and pairs of regions, and quantified items from findings.

Rules are data: a condition is SQL over a fixed set of columns, parsed by Spark and never evaluated in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.measure import rss
from .grids import numbered


@dataclass(frozen=True)
class Rule:
    id: str
    condition: str
    severity: str


# The published rules.
REGION_RULES = [
    Rule("ceiling_water_stain", "cls = 'water_stain' AND surface_kind = 'ceiling'", "high"),
    Rule("wall_base_moisture", "cls IN ('water_stain', 'mould') AND surface_kind = 'wall' AND height_above_floor_m < 0.3D", "medium"),
    Rule("near_wet_room_moisture", "cls IN ('water_stain', 'mould') AND surface_kind = 'wall' AND near_wet_room", "medium"),
    Rule("exterior_wall_mould", "cls = 'mould' AND surface_kind = 'wall' AND is_exterior_wall", "medium"),
    Rule("structural_crack", "cls = 'crack' AND (diagonal_from_opening_corner OR length_m > 0.5D)", "high"),
]
PAIR_RULE = Rule(
    "ceiling_wall_junction_stain",
    "a_cls = 'water_stain' AND b_cls = 'water_stain' AND ((a_surface_kind = 'ceiling' AND b_surface_kind = 'wall') OR (a_surface_kind = 'wall' AND b_surface_kind = 'ceiling')) "
    "AND centroid_dist_m < 0.75D AND ((a_surface_kind = 'wall' AND a_near_ceiling) OR (b_surface_kind = 'wall' AND b_near_ceiling))",
    "high",
)


#: Regions of a room that the rule engine pairs: for results that equal its own.
ENGINE_MOST = 400


@dataclass(frozen=True)
class ScopeRule:
    code: str
    classes: tuple[str, ...]
    kinds: tuple[str, ...]
    basis: str
    unit: str
    margin: float = 1.0


SCOPE_RULES = [
    ScopeRule("09.91-REPAINT-SURF", ("water_stain", "mould"), ("wall", "ceiling"), "surface_area", "m2"),
    ScopeRule("01.74-MOLD-REMED", ("mould",), ("wall", "ceiling"), "damage_area_margin", "m2", 1.3),
    ScopeRule("09.21-CRACK-FILL", ("crack",), ("wall", "ceiling"), "damage_length", "m"),
    ScopeRule("09.21-PATCH", ("hole_or_impact",), ("wall",), "count", "ea"),
    ScopeRule("09.91-PREP-REPAINT", ("peeling_paint",), ("wall", "ceiling"), "surface_area", "m2"),
]


def load_rules(spark: SparkSession, path: str, columns: list[str]) -> list[Rule]:
    """Rules (id, condition, severity) of a JSON lines file, in order of id. A condition that is not SQL over `columns`, or a repeated id, is an error when they are loaded."""
    rows = spark.read.schema("id string, condition string, severity string").json(path).orderBy("id").collect()  # a rule book, some tens of rows
    rules = [Rule(r.id, r.condition, r.severity) for r in rows]
    if len({r.id for r in rules}) < len(rules) or any(None in (r.id, r.condition, r.severity) for r in rules):
        raise ValueError(f"rules of {path} need ids of their own, a condition and a severity")
    empty = spark.createDataFrame([], ", ".join(columns))
    for r in rules:
        if dict(empty.select(F.expr(r.condition).alias("fits")).dtypes)["fits"] != "boolean":
            raise ValueError(f"rule {r.id} is no condition")
    return rules


def with_context(regions: DataFrame) -> DataFrame:
    """Adds what the conditions speak of: length, nearness to the ceiling, a wet room and an opening's corner (walls only)."""
    return regions.withColumns({
        "length_m": F.greatest("width_m", "height_m"), "near_ceiling": F.col("dist_to_ceiling_m") < 0.4, "near_wet_room": F.col("wet_room_dist_m") < 2.0,
        "diagonal_from_opening_corner": (F.col("surface_kind") == "wall") & (F.col("corner_dist_m") < 0.5)})


def region_flags(regions: DataFrame, rules: list[Rule]) -> DataFrame:
    """(region_id, surface_id, rule, severity, place): one row for each rule that a region fulfils. One pass over the regions: rules become an array that is filtered and unnested."""
    hits = F.filter(F.array(*[F.when(F.expr(r.condition), F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(k).alias("place"))) for k, r in enumerate(rules)]), lambda x: x.isNotNull())
    return with_context(regions).select(F.col("id").alias("region_id"), "surface_id", F.explode(hits).alias("f")).select("region_id", "surface_id", "f.rule", "f.severity", "f.place")


def numbered_flags(flags: DataFrame, prefix: str = "concealed") -> DataFrame:
    """Adds `flag_id`: a running number, by region and then by rule, with four digits at least."""
    return numbered(flags, ["region_id", "place"], "_k").withColumn("flag_id", F.format_string(f"{prefix}.%04d", "_k")).drop("_k")


def pair_flags(regions: DataFrame, rule: Rule, cell: float, most: int | None = None) -> DataFrame:
    """(room_id, a_id, b_id, rule) for pairs of a room's regions, a before b, that fulfil the rule.

    `most`: only a room's first regions, as the rule engine takes 400 (`ENGINE_MOST`). Only centroids within `cell` can pass, so pairs meet in
    cells of that width and a room is not joined with itself as a whole.
    """
    rows = with_context(regions)
    if most is not None:
        first = Window.partitionBy("room_id").orderBy("id")
        rows = rows.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most)
    columns = ["id", "cls", "surface_kind", "near_ceiling", "cx", "cz"]
    a = rows.select("room_id", *[F.col(c).alias(f"a_{c}") for c in columns], F.floor(F.col("cx") / cell).alias("_i"), F.floor(F.col("cz") / cell).alias("_j"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = rows.select("room_id", *[F.col(c).alias(f"b_{c}") for c in columns], F.explode(near).alias("_n"))
    b = b.withColumn("_i", F.floor(F.col("b_cx") / cell) + F.col("_n.i")).withColumn("_j", F.floor(F.col("b_cz") / cell) + F.col("_n.j"))
    pairs = a.join(b, ["room_id", "_i", "_j"]).where("a_id < b_id").withColumn("centroid_dist_m", F.sqrt((F.col("a_cx") - F.col("b_cx")) ** 2 + (F.col("a_cz") - F.col("b_cz")) ** 2))
    return pairs.where(F.expr(rule.condition)).select("room_id", "a_id", "b_id", F.lit(rule.id).alias("rule"))


def _basis(rule: ScopeRule) -> tuple[Column, Column]:
    """Aggregates: quantity and sigma of one rule over a surface's regions."""
    if rule.basis == "surface_area":
        area = F.col("length_m_s") * F.col("height")
        return F.max(area), F.max(area * rss(F.lit(0.01) / F.greatest(F.col("length_m_s"), F.lit(1e-6)), F.lit(0.02) / F.greatest(F.col("height"), F.lit(1e-6))))
    root = F.sqrt(F.sum(F.col("sigma") * F.col("sigma")))
    if rule.basis == "damage_area_margin":
        return F.sum("area_m2") * rule.margin, root * rule.margin
    if rule.basis == "damage_length":
        return F.sum(F.greatest("width_m", "height_m")), root
    if rule.basis == "count":
        return F.count(F.lit(1)).cast("double"), F.lit(0.0)
    raise ValueError(f"unknown basis {rule.basis!r}")


def scope_items(regions: DataFrame, surfaces: DataFrame, rules: list[ScopeRule]) -> DataFrame:
    """(code, surface_id, n, value, sigma, unit, triggered_by): one item for each rule and surface with confident regions of its classes.

    All rules are aggregated in one grouping: a region is unnested to the rules that take it.
    """
    matched = F.filter(F.array(*[F.when(F.col("cls").isin(*r.classes) & F.col("surface_kind").isin(*r.kinds), F.lit(k)) for k, r in enumerate(rules)]), lambda x: x.isNotNull())
    sized = surfaces.select("surface_id", F.col("length_m").alias("length_m_s"), "height")
    rows = regions.where(~F.col("low_confidence")).withColumn("_rule", F.explode(matched)).join(sized, "surface_id")
    value, sigma = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, r in enumerate(rules):
        v, s = _basis(r)
        value, sigma = F.when(F.col("_rule") == k, v).otherwise(value), F.when(F.col("_rule") == k, s).otherwise(sigma)
    pick = lambda field: F.element_at(F.array(*[F.lit(getattr(r, field)) for r in rules]), F.col("_rule") + 1)
    items = rows.groupBy("_rule", "surface_id").agg(F.count(F.lit(1)).alias("n"), value.alias("value"), sigma.alias("sigma"), F.sort_array(F.collect_list("id")).alias("triggered_by"))
    return items.select(pick("code").alias("code"), "surface_id", "n", "value", "sigma", pick("unit").alias("unit"), "triggered_by")
