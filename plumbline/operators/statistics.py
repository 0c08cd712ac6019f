"""Calibration, scoring and operating points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_percentiles, with_key_values

#: The published threshold grid.
GRID = {
    "min_score": [0.22, 0.24, 0.26, 0.28, 0.30, 0.32, 0.34, 0.36, 0.38, 0.40, 0.42, 0.46, 0.50],
    "min_views": [1, 2, 3],
    "min_consistency": [0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "min_contrast": [0.0, 3.0, 6.0, 9.0, 12.0, 15.0, 18.0, 22.0],
}


def wall_statistics(df: DataFrame, keys: tuple[str, ...], diff: str, length: str, sigma: str, absolute: float, relative: float) -> DataFrame:
    """Errors in millimetres and percent, calibration by z and by interval, and the share within either tolerance. Percentiles are exact and bracketed by a sketch."""
    e = F.abs(F.col(diff))
    z = F.col(diff) / F.col(sigma)
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 3)
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(z * z)), 2).alias("z_rms"), share(e <= F.col(sigma) * 1.96).alias("ci95_coverage"), share((e <= absolute) | (e <= F.col(length) * relative)).alias("pass_rate"))
    parts = F.explode(F.array(F.struct(F.lit(0).alias("_what"), (e * 1000).alias("_e")), F.struct(F.lit(1).alias("_what"), (e / F.col(length) * 100).alias("_e")))).alias("s")
    found = exact_percentiles(df.select(*keys, parts).select(*keys, "s.*"), (*keys, "_what"), "_e", [0.5, 0.9])  # both errors in one sketch and one count
    at = lambda what, k: F.max(F.when(F.col("_what") == what, F.col("p")[k]))
    errors = found.groupBy(*keys).agg(F.round(at(0, 0), 1).alias("median_abs_mm"), F.round(at(0, 1), 1).alias("p90_abs_mm"), F.round(at(1, 0), 2).alias("median_abs_pct"))
    return with_key_values(sums, errors, keys).select(*keys, "n", "median_abs_mm", "p90_abs_mm", "median_abs_pct", "z_rms", "ci95_coverage", "pass_rate")


def opening_score(df: DataFrame, ok: str, n_a: str, n_b: str) -> DataFrame:
    """Adds `score`: matches over the larger of both counts; null where there is nothing to match."""
    return df.withColumn("score", F.try_divide(F.col(ok), F.nullif(F.greatest(n_a, n_b), F.lit(0))))


def precision_recall(df: DataFrame, cls: str, truth: str, found: str) -> DataFrame:
    """Counts, precision and recall of each class; null on an empty denominator."""
    n = df.groupBy(cls).agg(F.count_if(truth).alias("n_truth"), F.count_if(found).alias("n_found"), F.count_if(F.col(truth) & F.col(found)).alias("n_matched"))
    return n.withColumn("precision", F.try_divide("n_matched", "n_found")).withColumn("recall", F.try_divide("n_matched", "n_truth"))


def sweep(df: DataFrame, grid: dict[str, list]) -> DataFrame:
    """False hits, hits and recall at each point of a grid of lower bounds (score, views, consistency, contrast).

    Rows are first counted by the highest step of each bound that they pass: the grid meets these
    counts, at most as many as it has points, instead of the rows.
    """
    steps = {"min_score": "score", "min_views": "views", "min_consistency": "consistency", "min_contrast": "contrast"}
    def passed(k: str, column: str):
        return F.size(F.filter(F.array(*[F.lit(x) for x in grid[k]]), lambda x: x <= F.col(column)))

    cells = df.withColumns({f"_{k}": passed(k, column) for k, column in steps.items()})
    counts = cells.groupBy(*[f"_{k}" for k in steps]).agg(F.count_if("truth").alias("t"), F.count_if(~F.col("truth")).alias("f"))
    total = df.agg(F.count_if("truth")).first()[0] or 0
    points = counts
    for k in steps:  # a count passes the bounds up to its step
        points = points.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0), F.col(f"_{k}"))))
    points = points.groupBy(*[f"i{k}" for k in steps]).agg(F.sum("t").alias("hits"), F.sum("f").alias("false_hits"))
    every = df.sparkSession.range(1)
    for k in steps:
        every = every.withColumn(f"i{k}", F.explode(F.sequence(F.lit(1), F.lit(len(grid[k])))))
    rows = every.drop("id").join(points, [f"i{k}" for k in steps], "left")
    bounds = [F.element_at(F.array(*[F.lit(x) for x in grid[k]]), F.col(f"i{k}")).alias(k) for k in steps]
    return rows.select(*bounds, F.coalesce("false_hits", F.lit(0)).alias("false_hits"), F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / F.lit(float(total))).alias("recall"))


def choose(points: DataFrame, most_false: int) -> DataFrame:
    """The point with at most `most_false` false hits and the highest recall, then the fewest false hits: one row or none."""
    return points.where(F.col("false_hits") <= most_false).orderBy(F.desc("recall"), "false_hits", "min_score", "min_views", "min_consistency", "min_contrast").limit(1)


def fuse(df: DataFrame, keys: tuple[str, ...], frame: str, score: str, color: tuple[str, ...], uv: tuple[str, str]) -> DataFrame:
    """Views of one region fused: distinct frames, confidence from score, views and colour spread, extent, and the spread of widths between views."""
    u, v = uv
    means = df.groupBy(*keys).agg(F.countDistinct(frame).alias("n_views"), F.avg(score).alias("_s"), *[F.avg(c).alias(f"_{c}") for c in color], (F.max(u) - F.min(u)).alias("width"), (F.max(v) - F.min(v)).alias("height"))
    square = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in color), F.lit(0.0))
    spread = df.join(means.select(*keys, *[f"_{c}" for c in color]), list(keys)).groupBy(*keys).agg(F.avg(F.sqrt(square)).alias("spread"))
    widths = df.groupBy(*keys, frame).agg((F.max(u) - F.min(u)).alias("_w")).groupBy(*keys).agg(F.stddev_pop("_w").alias("width_sd"))
    total = F.col("_s") * 0.5 + F.least(F.col("n_views") / 2.0, F.lit(1.0)) * 0.3 + F.exp(-F.col("spread") / 18.0) * 0.2
    confidence = F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)) * F.when(F.col("n_views") < 2, 0.6).otherwise(1.0)
    return means.join(spread, list(keys)).join(widths, list(keys)).withColumn("confidence", confidence)
