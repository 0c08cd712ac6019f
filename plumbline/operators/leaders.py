"""Leader clustering: seeds by descending size take what is near them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grids import cut

#: Cells are so small that two points of one cell are always near each other, so a cell has one leader at most.
_CELLS = 1.5
_REACH = 2


def _around(df: DataFrame) -> DataFrame:
    """Each row once for every cell within reach."""
    steps = F.sequence(F.lit(-_REACH), F.lit(_REACH))
    spots = df.withColumn("_di", F.explode(steps)).withColumn("_dj", F.explode(steps))
    return spots.withColumn("_i", F.col("_i") + F.col("_di")).withColumn("_j", F.col("_j") + F.col("_dj")).drop("_di", "_dj")


def leader_clusters(points: DataFrame, keys: tuple[str, ...], ident: str, x: str, z: str, size: str, radius: float = 0.35) -> DataFrame:
    """(keys, ident, leader): what a loop over the points by descending size (ties to the smaller ident) gives, in which a free point becomes a leader and takes all free points closer than `radius`.

    In rounds over cells of radius / 1.5, in which any two points are near each other. A cell's
    first open point leads if no cell within reach has an earlier one; then open points near a
    leader are settled. A round works on one point a cell, and on the open points next to new
    leaders; the rest waits. All keys and all separate places go on at once, so the number of rounds
    is that of the longest chain of ever smaller points that wait for each other. At the end each
    point takes the earliest leader near it, of the 25 that its cells can hold. Rows without a
    position or size take no part.
    """
    spot = [F.floor(F.col(c) / F.lit(radius / _CELLS)).alias(n) for c, n in ((x, "_i"), (z, "_j"))]
    rows = points.where(F.col(x).isNotNull() & F.col(z).isNotNull() & F.col(size).isNotNull()).select(*keys, *spot, F.struct((-F.col(size)).alias("first"), F.col(ident).alias("id")).alias("_o"), F.col(x).cast("double").alias("_x"), F.col(z).cast("double").alias("_z"))
    rows = cut(rows)
    cell = [*keys, "_i", "_j"]
    open_, leaders = rows, None
    while open_.limit(1).count():
        best = cut(open_.groupBy(*cell).agg(F.min(F.struct("_o", "_x", "_z")).alias("b")))
        lead = best.select(*cell, "b._o", "b._x", "b._z")
        least = _around(best.select(*cell, F.col("b._o").alias("_m"))).groupBy(*cell).agg(F.min("_m").alias("_m"))
        new = cut(lead.join(least, cell).where(F.col("_o") == F.col("_m")).drop("_m"))
        leaders = new if leaders is None else leaders.unionByName(new)
        near = _around(new.select(*cell, F.col("_x").alias("_lx"), F.col("_z").alias("_lz")))
        taken = open_.join(near, cell).where((F.col("_x") - F.col("_lx")) ** 2 + (F.col("_z") - F.col("_lz")) ** 2 < radius * radius).select(*cell, "_o").distinct()
        open_ = cut(open_.join(taken, [*cell, "_o"], "left_anti"))
    if leaders is None:
        return rows.select(*keys, F.col("_o.id").alias(ident), F.col("_o.id").alias("leader"))
    near = _around(leaders.select(*cell, F.col("_o").alias("_l"), F.col("_x").alias("_lx"), F.col("_z").alias("_lz")))
    inside = ((F.col("_x") - F.col("_lx")) ** 2 + (F.col("_z") - F.col("_lz")) ** 2 < radius * radius) & (F.col("_l") <= F.col("_o"))
    return rows.join(near, cell).where(inside).groupBy(*keys, "_o").agg(F.min("_l").alias("_l")).select(*keys, F.col("_o.id").alias(ident), F.col("_l.id").alias("leader"))
