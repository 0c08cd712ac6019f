"""Sparse raster operators on cells (i, j): morphology, components, growth, boundaries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
SQUARE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def shared_dir(spark) -> str:
    """The cluster's shared folder for steps of a loop (spark.checkpoint.dir). Where it is unset a local session gets a temporary one; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again, so that a loop's plan and lineage stay short and survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _offsets(kernel: list[tuple[int, int]]):
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in kernel])


def dilate(cells: DataFrame, kernel=CROSS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells within the kernel of a cell."""
    moved = cells.select(*keys, "i", "j", F.explode(_offsets(kernel)).alias("d"))
    return moved.select(*keys, (F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j")).distinct()


def erode(cells: DataFrame, kernel=CROSS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells whose whole kernel is occupied; what lies outside the raster is empty."""
    moved = cells.select(*keys, "i", "j").distinct().select(*keys, "i", "j", F.explode(_offsets(kernel)).alias("d"))
    counts = moved.groupBy(*keys, (F.col("i") - F.col("d.a")).alias("i"), (F.col("j") - F.col("d.b")).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") == len(kernel)).select(*keys, "i", "j")


def opened(cells: DataFrame, kernel=SQUARE, times: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    for step in (erode, dilate):
        for _ in range(times):
            cells = step(cells, kernel, keys)
    return cells


def _merged(runs: DataFrame, row: list[str]) -> DataFrame:
    """(row, lo, hi): runs of each row, those that meet or touch as one."""
    w = Window.partitionBy(*row).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_new", F.coalesce(F.col("lo") > before + 1, F.lit(True)))
    named = marked.withColumn("_at", F.last(F.when(F.col("_new"), F.col("lo")), ignorenulls=True).over(w))
    return named.groupBy(*row, "_at").agg(F.max("hi").alias("hi")).withColumnRenamed("_at", "lo")


def row_runs(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, lo, hi): each row's cells as runs from one to another, both in them."""
    row = [*keys, "i"]
    return _merged(cells.where("j is not null").select(*row, F.col("j").alias("lo"), F.col("j").alias("hi")), row)


def closed_runs(runs: DataFrame, times: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, lo, hi): runs of cells dilated and then eroded `times` times by the square.

    That is a dilation and an erosion by the square of 2 * times + 1. Runs grow at their ends and go to the rows
    around theirs, where they are merged; shortened at their ends, they are left where all the rows around have one.
    """
    row, wide = [*keys, "i"], 2 * times + 1
    types = dict(runs.dtypes)
    spread = lambda df: df.withColumn("_d", F.explode(F.array(*[F.lit(k) for k in range(-times, times + 1)]))).withColumn("i", (F.col("i") + F.col("_d")).cast(types["i"])).drop("_d")
    grown = _merged(spread(runs.select(*row, (F.col("lo") - times).alias("lo"), (F.col("hi") + times).alias("hi"))), row)
    shrunk = spread(grown.select(*row, (F.col("lo") + times).alias("lo"), (F.col("hi") - times).alias("hi")))
    ends = F.array(F.struct(F.col("lo").alias("j"), F.lit(1).alias("n")), F.struct((F.col("hi") + 1).alias("j"), F.lit(-1).alias("n")))
    steps = shrunk.select(*row, F.explode(ends).alias("e")).groupBy(*row, "e.j").agg(F.sum("e.n").alias("n"))
    w = Window.partitionBy(*row).orderBy("j")
    held = steps.withColumns({"_n": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_next": F.lead("j").over(w)}).where(F.col("_n") == wide)
    return held.select(*row, F.col("j").cast(types["lo"]).alias("lo"), (F.col("_next") - 1).cast(types["hi"]).alias("hi"))


def cells_of(runs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j): the cells of runs."""
    return runs.select(*keys, "i", F.explode(F.sequence("lo", "hi")).alias("j"))


def closed(cells: DataFrame, kernel=SQUARE, times: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    if kernel == SQUARE:
        return cells_of(closed_runs(row_runs(cells, keys), times, keys), keys)
    for step in (dilate, erode):
        for _ in range(times):
            cells = step(cells, kernel, keys)
    return cells


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for nodes (node): the least node reachable over edges (x, y).

    Each round hangs the larger neighbours of a node under its least neighbour and then a node's
    other ends under its least one, so paths shorten by half and edges become stars. A round is one
    write to the shared folder; minima are aggregated, so no node's neighbours meet in one place.
    """
    stars = cut(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        ends = large.join(large.groupBy("x").agg(F.min("y").alias("m")), "x")
        hung = ends.select("x", F.col("m").alias("y")).unionByName(ends.select(F.col("y").alias("x"), F.col("m").alias("y"))).where("x <> y").distinct()
        stars = cut(hung)
        now = tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.select("node").distinct().join(stars.withColumnRenamed("x", "node"), "node", "left").select("node", F.coalesce("y", "node").alias("component"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds a running number from 1 in the given order. Rows are numbered in ranges, to which the counts of the ranges before are added, so no task has all rows."""
    ranges = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, as many as partitions
    offsets = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return ranges.join(F.broadcast(offsets), "_part").withColumn(name, number).drop("_part", "_before")


def cell_components(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, component): 4-connected components of each key's cells, named by the id of their first cell in raster order (with the keys, if there are any).

    Cells of a row that touch are one run first, so the graph has a node a run and an edge for each
    two runs that lie beside each other, and takes fewer rounds.
    """
    ident = F.shiftleft(F.col("i").cast("long") + F.lit(1 << 30), 32) + (F.col("j").cast("long") + F.lit(1 << 30))
    ident = F.struct(*keys, ident.alias("at")) if keys else ident
    row = Window.partitionBy(*keys, "i").orderBy("j")
    own = cells.select(*keys, "i", "j").distinct().withColumn("_new", F.coalesce(F.col("j") - F.lag("j").over(row) != 1, F.lit(True)))
    own = cut(own.select(*keys, "i", "j", F.last(F.when(F.col("_new"), ident), ignorenulls=True).over(row).alias("node")))
    below = own.select(*keys, (F.col("i") + 1).alias("i"), "j", F.col("node").alias("x"))
    edges = below.join(own.withColumnRenamed("node", "y"), [*keys, "i", "j"]).select("x", "y").distinct()
    return own.join(components(own, edges), "node").select(*keys, "i", "j", "component")


def label_components(cells: DataFrame) -> DataFrame:
    """(i, j, label): 4-connected components, numbered by their first cell in raster order."""
    found = cut(cell_components(cells))
    names = numbered(found.select("component").distinct(), ["component"], "label").withColumn("label", F.col("label").cast("int"))
    return found.join(names, "component").select("i", "j", "label")


def grow(markers: DataFrame, domain: DataFrame) -> DataFrame:
    """(i, j, label): markers spread over the domain one cell a round; of several labels the greatest wins."""
    labels = cut(markers.select("i", "j", "label"))
    space = domain.select("i", "j").distinct()
    while True:
        moved = labels.select("label", "i", "j", F.explode(_offsets(CROSS[1:])).alias("d")).select((F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j"), "label")
        fresh = moved.join(space, ["i", "j"], "left_semi").join(labels, ["i", "j"], "left_anti").groupBy("i", "j").agg(F.max("label").alias("label"))
        fresh = cut(fresh)
        if not fresh.limit(1).count():
            return labels
        labels = cut(labels.unionByName(fresh))


def component_stats(labels: DataFrame, res: float) -> DataFrame:
    """(label, area, wall_share) of labelled cells (i, j, label, barrier)."""
    return labels.groupBy("label").agg((F.count(F.lit(1)) * res * res).alias("area"), F.avg(F.col("barrier").cast("double")).alias("wall_share"))


def marked_largest(stats: DataFrame) -> DataFrame:
    """Adds `largest`: the label with the most area, the least of equals. One row is sent to all."""
    best = stats.agg(F.max_by("label", F.struct("area", -F.col("label"))).alias("_best"))
    return stats.crossJoin(F.broadcast(best)).withColumn("largest", F.col("label") == F.col("_best")).drop("_best")


def boundary_lengths(labels: DataFrame) -> DataFrame:
    """(a, b, n): neighbouring cell pairs between two labels, for each unordered pair of labels."""
    steps = F.array(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")))
    moved = labels.select("label", "i", "j", F.explode(steps).alias("d")).select(F.col("label").alias("la"), (F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j"))
    pairs = moved.join(labels.withColumnRenamed("label", "lb"), ["i", "j"]).where("la <> lb")
    return pairs.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def window_mode(labels: DataFrame, at: DataFrame, reach: int = 3) -> DataFrame:
    """(i, j, label): the commonest label in the square around each asked cell; of equals the least."""
    square = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]
    asked = at.select("i", "j").distinct().select("i", "j", F.explode(_offsets(square)).alias("d"))
    near = asked.select(F.col("i").alias("ai"), F.col("j").alias("aj"), (F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j")).join(labels, ["i", "j"])
    votes = near.groupBy("ai", "aj", "label").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("ai", "aj").orderBy(F.desc("n"), "label")
    return votes.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(F.col("ai").alias("i"), F.col("aj").alias("j"), "label", "n")
