"""Two plans of one place compared: registered, matched room by room, wall by wall and opening by opening, and scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import rasters as T


def turned_cells(cells: DataFrame, turns: int) -> DataFrame:
    """Cells turned by quarter turns about the origin's corner."""
    i, j = F.col("i"), F.col("j")
    return cells.withColumns(dict(zip("ij", [(i, j), (-j - 1, i), (-i - 1, -j - 1), (j, -i - 1)][turns], strict=True)))


def registration(a: DataFrame, b: DataFrame, key: str, reach: int) -> DataFrame:
    """(key, turns, di, dj, overlap): the quarter turn and shift of b's cells that cover most of a's, centres brought together first; the first turn of equals."""
    centre = a.groupBy(key).agg(F.round(F.avg("i")).cast("long").alias("_ai"), F.round(F.avg("j")).cast("long").alias("_aj"))
    found = None
    for turns in range(4):
        moved = turned_cells(b, turns)
        own = moved.groupBy(key).agg(F.round(F.avg("i")).cast("long").alias("_bi"), F.round(F.avg("j")).cast("long").alias("_bj"))
        offset = centre.join(own, key).select(key, (F.col("_ai") - F.col("_bi")).alias("_di"), (F.col("_aj") - F.col("_bj")).alias("_dj"))
        near = moved.join(offset, key).select(key, (F.col("i") + F.col("_di")).alias("i"), (F.col("j") + F.col("_dj")).alias("j"))
        best = T.best_shift(a.select(key, "i", "j"), near, reach, (key,)).join(offset, key)
        best = best.select(key, F.lit(turns).alias("turns"), (F.col("di") + F.col("_di")).alias("di"), (F.col("dj") + F.col("_dj")).alias("dj"), "overlap")
        found = best if found is None else found.unionByName(best)
    return found.groupBy(key).agg(F.max_by(F.struct("turns", "di", "dj", "overlap"), F.struct("overlap", -F.col("turns"))).alias("m")).select(key, "m.*")


def room_matches(a: DataFrame, b: DataFrame, key: str, least: float = 0.4) -> DataFrame:
    """(key, a, b, iou): rooms matched one to one by the cells they share, the best first. Labelled cells (key, room, i, j) meet by an equality join."""
    both = a.withColumnRenamed("room", "a").join(b.withColumnRenamed("room", "b"), [key, "i", "j"]).groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("_n"))
    size = lambda df, name: df.groupBy(key, F.col("room").alias(name)).agg(F.count(F.lit(1)).alias(f"_{name}"))
    iou = both.join(size(a, "a"), [key, "a"]).join(size(b, "b"), [key, "b"]).select(key, "a", "b", (F.col("_n") / (F.col("_a") + F.col("_b") - F.col("_n"))).alias("iou"))
    best = iou.groupBy(key, "a").agg(F.max_by("b", F.struct("iou", -F.hash("b"))).alias("b"), F.max("iou").alias("iou")).where(F.col("iou") >= least)
    return J.greedy_pairs(best, (key,), "a", "b", "iou")


def wall_matches(a: DataFrame, b: DataFrame, key: str, *, dot: float = 0.9, across: float = 0.15, along: float = 0.5, most: float = 0.35, cell: float = 1.0) -> DataFrame:
    """(key, a, b, score, length_a, length_b): walls (key, wall, x1, z1, x2, z2) matched one to one in the order of a, each to its nearest free one.

    Both must look the same way, lie within `across` of each other's line and have middles within `along`
    of the longer one. Middles meet in cells of `cell` (a wall of b in those that its length reaches).
    """
    def side(df: DataFrame, s: str) -> DataFrame:
        dx, dz = F.col("x2") - F.col("x1"), F.col("z2") - F.col("z1")
        n = F.greatest(F.hypot(dx, dz), F.lit(1e-9))
        return df.select(key, F.col("wall").alias(s), ((F.col("x1") + F.col("x2")) / 2).alias(f"mx_{s}"), ((F.col("z1") + F.col("z2")) / 2).alias(f"mz_{s}"), (dx / n).alias(f"ux_{s}"), (dz / n).alias(f"uz_{s}"), n.alias(f"length_{s}"))

    x, y = side(a, "a"), side(b, "b")
    longest = F.greatest("length_a", "length_b")
    reach = lambda s: F.ceil(F.col(f"length_{s}") * along / cell + across / cell).cast("int")
    wide = [d.withColumn("_i", F.explode(F.sequence(F.floor(F.col(f"mx_{s}") / cell) - reach(s), F.floor(F.col(f"mx_{s}") / cell) + reach(s)))).withColumn("_j", F.explode(F.sequence(F.floor(F.col(f"mz_{s}") / cell) - reach(s), F.floor(F.col(f"mz_{s}") / cell) + reach(s)))) for d, s in ((x, "a"), (y, "b"))]
    exact = [d.withColumn("_i", F.floor(F.col(f"mx_{s}") / cell)).withColumn("_j", F.floor(F.col(f"mz_{s}") / cell)) for d, s in ((x, "a"), (y, "b"))]
    pairs = exact[0].join(wide[1], [key, "_i", "_j"]).unionByName(wide[0].join(exact[1], [key, "_i", "_j"])).drop("_i", "_j").distinct()
    ex, ez = F.col("mx_b") - F.col("mx_a"), F.col("mz_b") - F.col("mz_a")
    d_across, d_along = F.abs(ex * -F.col("uz_a") + ez * F.col("ux_a")), F.abs(ex * F.col("ux_a") + ez * F.col("uz_a"))
    same = F.col("ux_a") * F.col("ux_b") + F.col("uz_a") * F.col("uz_b") >= dot
    pairs = pairs.where(same & (d_across < across) & (d_along < along * longest)).withColumn("score", F.round(d_across + d_along / longest * across, 9)).where(F.col("score") < most)
    return J.greedy_pairs(pairs.select(key, "a", "b", (-F.col("score")).alias("score"), "length_a", "length_b"), (key,), "a", "b", "score", best_first=False).withColumn("score", -F.col("score"))


def spot_matches(a: DataFrame, b: DataFrame, keys: tuple[str, ...], reach: float = 0.35) -> DataFrame:
    """(keys, a, b, dist): spots (keys, id, x, z) matched one to one, in the order of a, each to its nearest free one within `reach`: openings, or found and true damage of one class."""
    cell = lambda c: F.floor(F.col(c) / reach)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    x = a.select(*keys, F.col("id").alias("a"), F.col("x").alias("xa"), F.col("z").alias("za"), cell("x").alias("_i"), cell("z").alias("_j"))
    y = b.select(*keys, F.col("id").alias("b"), F.col("x").alias("xb"), F.col("z").alias("zb"), F.explode(near).alias("s"))
    y = y.withColumn("_i", F.floor(F.col("xb") / reach) + F.col("s.i")).withColumn("_j", F.floor(F.col("zb") / reach) + F.col("s.j")).drop("s")
    dist = F.round(F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("za") - F.col("zb")) ** 2), 9)
    pairs = x.join(y, [*keys, "_i", "_j"]).select(*keys, "a", "b", (-dist).alias("dist")).where(F.col("dist") > -reach)
    return J.greedy_pairs(pairs, keys, "a", "b", "dist", best_first=False).withColumn("dist", -F.col("dist"))


def report(scores: DataFrame, title: str, columns: list[str], order: list[str]) -> DataFrame:
    """(line): the scores as a Markdown table, one row of text for each line, in order: written with `.write.text`."""
    head = scores.sparkSession.createDataFrame([(0, f"## {title}"), (1, ""), (2, "| " + " | ".join(columns) + " |"), (3, "|" + "---|" * len(columns))], "n long, line string")
    from pyspark.sql import Window

    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |"))
    rows = scores.select((F.row_number().over(Window.orderBy(*order)) + 3).cast("long").alias("n"), cells.alias("line"))  # a table of scores, some tens of rows
    return head.unionByName(rows).orderBy("n").select("line")
