"""Measurements as structs: value, sigma, unit, method and the budget of error terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the half width of a 95% interval in sigmas.
Z95 = 1.959964


def rss(*sigmas: Column) -> Column:
    """Root of the sum of squares; a null term counts as 0."""
    total = F.lit(0.0)
    for s in sigmas:
        total = total + F.coalesce(s, F.lit(0.0)) * F.coalesce(s, F.lit(0.0))
    return F.sqrt(total)


def measurement(value: Column, sigma: Column, unit: str = "m", method: str = "", budget: Column | None = None) -> Column:
    return F.struct(
        value.cast("double").alias("value"), sigma.cast("double").alias("sigma"), F.lit(unit).alias("unit"), F.lit(method).alias("method"),
        (budget if budget is not None else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).alias("budget"),
    )


def ci95(m: Column) -> tuple[Column, Column]:
    return m["value"] - m["sigma"] * Z95, m["value"] + m["sigma"] * Z95


def length(value: Column, plane_a: Column, plane_b: Column, scale: Column, **extra: Column) -> Column:
    """A length between two planes: both planes' sigmas, the relative scale error and further terms, kept as a budget."""
    terms = {"plane_a": plane_a, "plane_b": plane_b, "scale": F.abs(value) * scale, **extra}
    budget = F.create_map(*[x for k, v in terms.items() for x in (F.lit(k), v.cast("double"))])
    return measurement(value, rss(*terms.values()), "m", "length", budget)


def area(value: Column, perimeter: Column, edge_sigma: Column, scale: Column) -> Column:
    """An area: edges give perimeter * sigma / sqrt(2), the scale error enters twice."""
    return measurement(value, rss(perimeter * edge_sigma / F.sqrt(F.lit(2.0)), F.abs(value) * scale * 2), "m2", "area")


def product(a_value: Column, a_sigma: Column, b_value: Column, b_sigma: Column) -> Column:
    """An area as a product of two lengths, with relative sigmas combined."""
    relative = rss(a_sigma / F.greatest(a_value, F.lit(1e-6)), b_sigma / F.greatest(b_value, F.lit(1e-6)))
    return measurement(a_value * b_value, a_value * b_value * relative, "m2", "product")


def summed(values: Column, sigmas: Column, scale: float = 1.0) -> tuple[Column, Column]:
    """Aggregates: scaled sum and its sigma for independent terms."""
    return F.sum(values) * scale, F.sqrt(F.sum(sigmas * sigmas)) * scale


def rounded(m: Column, places: int = 4) -> Column:
    """The published form: value and interval to 4 places, sigma and budget to 5."""
    lo, hi = ci95(m)
    return F.struct(
        F.round(m["value"], places).alias("value"), F.round(m["sigma"], places + 1).alias("sigma"), F.array(F.round(lo, places), F.round(hi, places)).alias("ci95"),
        m["unit"].alias("unit"), m["method"].alias("method"), F.transform_values(m["budget"], lambda _, v: F.round(v, places + 1)).alias("budget"),
    )


def plane_sigma(sd: Column, n: Column, bias: Column) -> Column:
    """Sigma of a fitted plane: spread over the root of an effective count of n / 25 (1 to 400), and a bias."""
    return rss(sd / F.sqrt(F.least(F.greatest(n / 25.0, F.lit(1.0)), F.lit(400.0))), bias)


def observed_sigma(sd: Column, n: Column, bias: Column, height: Column, coverage: Column, penalty: float) -> Column:
    """Sigma of a wall plane by what was seen of it: unseen, occluded (below 1.6) or seen; always with the missing coverage."""
    base = F.when(n.isNull() | (n == 0), rss(bias, F.lit(0.30))).otherwise(
        F.when(height < 1.6, rss(plane_sigma(sd, n, bias), F.lit(0.25))).otherwise(plane_sigma(sd, n, bias)))
    return rss(base, (F.lit(1.0) - coverage) * penalty)


def plane_state(n: Column, height: Column) -> Column:
    """`unseen`, `occluded` (seen below 1.6 only: it may be furniture) or `wall`."""
    return F.when(n.isNull() | (n == 0), "unseen").when(height < 1.6, "occluded").otherwise("wall")


def ceiling_height(value: Column, ceiling_sd: Column, ceiling_n: Column, floor_sd: Column, floor_n: Column, bias: Column, scale: Column) -> Column:
    """The height between two fitted planes: both fits, the bias of two planes and the scale, kept as a budget."""
    fit = rss(plane_sigma(ceiling_sd, ceiling_n, F.lit(0.0)), plane_sigma(floor_sd, floor_n, F.lit(0.0)))
    terms = {"fit": fit, "plane_bias": bias * F.sqrt(F.lit(2.0)), "scale": value * scale}
    budget = F.create_map(*[x for k, v in terms.items() for x in (F.lit(k), v.cast("double"))])
    return measurement(value, rss(*terms.values()), "m", "ceiling plane - floor plane", budget)


def surface_area(kind: Column, length: Column, length_sigma: Column, height: Column, height_sigma: Column, room_area: Column, room_sigma: Column) -> tuple[Column, Column]:
    """Area and sigma of a surface: length times height of a wall, the room's own area of a floor or ceiling."""
    wall = product(length, length_sigma, height, height_sigma)
    return F.when(kind == "wall", wall["value"]).otherwise(room_area), F.when(kind == "wall", wall["sigma"]).otherwise(room_sigma)


def damage_sigmas(distance: Column, width: Column, height: Column, absolute: float = 0.01, relative: float = 0.01) -> tuple[Column, Column]:
    """Sigmas of a damage region's depth, by its distance, and of its border, by its smaller extent."""
    return F.lit(absolute) + F.lit(relative) * distance, F.greatest(F.lit(0.015), F.lit(0.03) * F.least(width, height))


def millimetres(metres: Column) -> Column:
    return F.round(metres * 1000, 1)


def percent(part: Column, whole: Column) -> Column:
    return F.round(part / whole * 100, 2)


def ceiling_prior(p995: Column, n: Column) -> tuple[Column, Column]:
    """Value and sigma of an unobserved ceiling from the highest points below it."""
    low = F.when(n <= 50, F.lit(2.2)).otherwise(F.greatest(p995, F.lit(2.0)))
    return F.greatest(low, F.lit(2.5)), F.greatest(F.lit(0.15), (F.lit(3.2) - low) / 3.92)


def link_sigma(inliers: Column) -> Column:
    return F.greatest(F.lit(0.03), F.lit(0.5) / F.sqrt(inliers))


def jamb_sigma(sd: Column, n: Column) -> Column:
    return F.coalesce(rss(sd / F.sqrt(F.least(F.greatest(n / 10.0, F.lit(1.0)), F.lit(200.0))), F.lit(0.003)), F.lit(0.02))


def affine(matrix: Sequence[Column] | Column, x: Column, y: Column, z: Column, translate: bool = True) -> list[Column]:
    """The three coordinates of a row-major 4x4 matrix (an array column or 16 columns) applied to a point, or to a direction."""
    t = [matrix[i] for i in range(12)]
    return [t[4 * r] * x + t[4 * r + 1] * y + t[4 * r + 2] * z + (t[4 * r + 3] if translate else F.lit(0.0)) for r in range(3)]


def quaternion_matrix(qx: Column, qy: Column, qz: Column, qw: Column, x: Column, y: Column, z: Column) -> Column:
    """Row-major 4x4 pose of a unit quaternion and a position."""
    n = F.sqrt(qx * qx + qy * qy + qz * qz + qw * qw)
    a, b, c, d = qx / n, qy / n, qz / n, qw / n
    one = F.lit(1.0)
    return F.array(
        one - 2 * (b * b + c * c), 2 * (a * b - c * d), 2 * (a * c + b * d), x,
        2 * (a * b + c * d), one - 2 * (a * a + c * c), 2 * (b * c - a * d), y,
        2 * (a * c - b * d), 2 * (b * c + a * d), one - 2 * (a * a + b * b), z,
        F.lit(0.0), F.lit(0.0), F.lit(0.0), one,
    )


def snap90(angle: Column) -> Column:
    """An angle in radians at the nearest quarter turn, halves to even."""
    return F.bround(angle / F.lit(1.5707963267948966)) * F.lit(1.5707963267948966)


def se2_compose(yaw_a: Column, tx_a: Column, tz_a: Column, yaw_b: Column, tx_b: Column, tz_b: Column) -> tuple[Column, Column, Column]:
    """First b, then a, of planar motions (yaw, tx, tz)."""
    return yaw_a + yaw_b, F.cos(yaw_a) * tx_b - F.sin(yaw_a) * tz_b + tx_a, F.sin(yaw_a) * tx_b + F.cos(yaw_a) * tz_b + tz_a


def se2_invert(yaw: Column, tx: Column, tz: Column) -> tuple[Column, Column, Column]:
    return -yaw, -(F.cos(yaw) * tx + F.sin(yaw) * tz), F.sin(yaw) * tx - F.cos(yaw) * tz
