"""Errors of estimated trajectories against true ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grids import cut, numbered
from .quantiles import exact_percentiles


def similarities_of(points: DataFrame, keys: tuple[str, ...], p: tuple[str, str, str], q: tuple[str, str, str]) -> DataFrame:
    """(keys, n, scale, rotation, shift): the least-squares similarity q = scale * R p + shift of each key's points, however many.

    Means are one aggregate and centred moments another: 11 sums a key, from which a small
    decomposition of each key gives the rotation. Null coordinates are passed over. Fewer than three
    points, or points in one place, give a rotation of nothing and scale 1.
    """
    import numpy as np
    import pandas as pd

    ok = points.where(" and ".join(f"{c} is not null" for c in (*p, *q)))
    means = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_m{k}") for k, c in enumerate((*p, *q))])
    apart = ok.join(means, list(keys)).select(*keys, "n", *[f"_m{k}" for k in range(6)], *[(F.col(c) - F.col(f"_m{k}")).alias(f"_d{k}") for k, c in enumerate((*p, *q))])
    moments = apart.groupBy(*keys, "n", *[f"_m{k}" for k in range(6)]).agg(
        F.array(*[F.sum(F.col(f"_d{a + 3}") * F.col(f"_d{b}")) for a in range(3) for b in range(3)]).alias("_c"), F.sum(sum((F.col(f"_d{k}") * F.col(f"_d{k}") for k in range(3)), F.lit(0.0))).alias("_v"))

    def fit(parts):
        for rows in parts:
            out = []
            for r in rows.itertuples(index=False):
                c = np.array(r._asdict()["_c"] if "_c" in r._fields else r[len(keys) + 7], float).reshape(3, 3)
                v = float(r[len(keys) + 8])
                m = np.array(r[len(keys) + 1 : len(keys) + 7], float)
                left, size, right = np.linalg.svd(c)
                sign = np.array([1.0, 1.0, np.sign(np.linalg.det(left) * np.linalg.det(right)) or 1.0])
                turn, scale = (left * sign) @ right, float((size * sign).sum() / v) if v > 0 else 1.0
                if r[len(keys)] < 3 or v <= 0:
                    turn, scale = np.eye(3), 1.0
                out.append([*r[: len(keys) + 1], scale, turn.ravel().tolist(), (m[3:] - scale * turn @ m[:3]).tolist()])
            yield pd.DataFrame(out, columns=[*keys, "n", "scale", "rotation", "shift"])

    types = dict(points.dtypes)
    return moments.mapInPandas(fit, ", ".join([*(f"{k} {types[k]}" for k in keys), "n long, scale double, rotation array<double>, shift array<double>"]))


def trajectory_errors(poses: DataFrame, keys: tuple[str, ...], order: str, estimate: tuple[str, str, str], truth: tuple[str, str, str], *, least_step: float = 0.01) -> DataFrame:
    """(keys, n, ate, scale, scale_error_pct, ratio_sd, drift_pct) of each key's trajectory.

    `ate` is the root mean square distance after the best similarity. The steps' lengths, estimated
    over true, need no fit: `ratio_sd` is their deviation, and `drift_pct` the change of their median
    from the first half of the steps to the second. Steps of `least_step` or less are left out. A
    trajectory may have any length: places are numbered in ranges, neighbours meet in a join on the
    number, medians are bracketed by a sketch.
    """
    near = cut(poses.select(*keys, F.col(order).alias("_o"), *[F.col(c).cast("double").alias(f"_e{k}") for k, c in enumerate(estimate)], *[F.col(c).cast("double").alias(f"_t{k}") for k, c in enumerate(truth)]))
    e, t = ("_e0", "_e1", "_e2"), ("_t0", "_t1", "_t2")
    fits = cut(similarities_of(near, keys, e, t))
    moved = [F.col("scale") * sum((F.col("rotation")[3 * a + b] * F.col(f"_e{b}") for b in range(3)), F.lit(0.0)) + F.col("shift")[a] - F.col(f"_t{a}") for a in range(3)]
    ate = near.join(fits, list(keys)).groupBy(*keys).agg(F.sqrt(F.avg(sum((d * d for d in moved), F.lit(0.0)))).alias("ate"))

    placed = cut(numbered(near, [*keys, "_o"], "_n"))
    after = placed.select(*keys, (F.col("_n") - 1).alias("_n"), *[F.col(c).alias(f"{c}_") for c in (*e, *t)])
    length = lambda names: F.sqrt(sum(((F.col(f"{c}_") - F.col(c)) ** 2 for c in names), F.lit(0.0)))
    steps = placed.join(after, [*keys, "_n"]).select(*keys, "_n", length(e).alias("_a"), length(t).alias("_b")).where(F.col("_b") > least_step).select(*keys, "_n", (F.col("_a") / F.col("_b")).alias("ratio"))
    steps = cut(numbered(steps, [*keys, "_n"], "_k"))
    ends = steps.groupBy(*keys).agg(F.min("_k").alias("_first"), F.count(F.lit(1)).alias("_steps"), F.stddev_pop("ratio").alias("ratio_sd"))
    half = F.when(F.col("_k") - F.col("_first") < F.greatest(F.floor(F.col("_steps") / 2), F.lit(1)), 0).otherwise(1)
    medians = exact_percentiles(steps.join(ends, list(keys)).select(*keys, half.alias("_half"), "ratio"), (*keys, "_half"), "ratio", [0.5])
    sides = medians.groupBy(*keys).agg(F.max(F.when(F.col("_half") == 0, F.col("p")[0])).alias("_s1"), F.max(F.when(F.col("_half") == 1, F.col("p")[0])).alias("_s2"))
    drift = F.abs(F.coalesce("_s2", "_s1") - F.col("_s1")) / F.greatest("_s1", F.lit(1e-6)) * 100
    told = ends.join(sides, list(keys)).select(*keys, "ratio_sd", drift.alias("drift_pct"))
    return fits.join(ate, list(keys)).join(told, list(keys), "left").select(*keys, "n", "ate", "scale", (F.abs(F.col("scale") - 1) * 100).alias("scale_error_pct"), "ratio_sd", "drift_pct")
