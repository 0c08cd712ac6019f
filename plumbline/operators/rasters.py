"""Raster operators on cells (keys, i, j): holes, interiors, drawn segments, votes, shifts, sharpness."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grids import CROSS, SQUARE, _offsets, cell_components, closed, components, cut, dilate, opened, row_runs
from .quantiles import with_key_values


def _ident(i: str = "i", j: str = "j"):
    return F.shiftleft(F.col(i).cast("long") + F.lit(1 << 30), 32) + (F.col(j).cast("long") + F.lit(1 << 30))


def holes(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, hole): empty cells of each key's bounding box that no 4-connected path of empty cells joins to its border, with the least cell's id of each hole."""
    return run_holes(cut(row_runs(cells, keys)), keys)


def run_holes(runs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, hole) as `holes`, of cells in runs (keys, i, lo, hi): the empty cells of a row lie between its runs, and between those and the box."""
    box = runs.groupBy(*keys).agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("lo").alias("j0"), F.max("hi").alias("j1")).where("i0 is not null")
    row = [*keys, "i"]
    ends = box.withColumn("i", F.explode(F.sequence("i0", "i1"))).withColumn("e", F.explode(F.array(F.col("j0") - 1, F.col("j1") + 1)))
    both = runs.select(*row, "lo", "hi").unionByName(ends.select(*row, F.col("e").alias("lo"), F.col("e").alias("hi")))
    gaps = both.withColumns({"_from": F.col("hi") + 1, "_to": F.lead("lo").over(Window.partitionBy(*row).orderBy("lo")) - 1}).where("_to >= _from")
    empty = with_key_values(gaps.select(*row, "_from", "_to"), box, keys).withColumn("j", F.explode(F.sequence("_from", "_to")))
    edge = (F.col("i") == F.col("i0")) | (F.col("i") == F.col("i1")) | (F.col("j") == F.col("j0")) | (F.col("j") == F.col("j1"))
    at = [*row, "j"]
    empty = cut(empty.select(*at, edge.alias("edge")))
    found = cut(empty.join(cell_components(empty, keys), at))
    open_ = found.where("edge").select("component").distinct()
    return found.join(open_, "component", "left_anti").select(*at, F.col("component").alias("hole"))


def fill_holes(cells: DataFrame, *, keys: tuple[str, ...] = (), most: int | None = None, barrier: DataFrame | None = None, wall_share: float = 0.25) -> DataFrame:
    """Cells with their holes filled: all, or those of fewer than `most` cells whose share of barrier cells is under `wall_share`."""
    found, at = holes(cells, keys), [*keys, "i", "j"]
    if most is not None or barrier is not None:
        wall = barrier.select(*at).distinct().withColumn("_w", F.lit(1.0)) if barrier is not None else found.select(*at).where(F.lit(False)).withColumn("_w", F.lit(1.0))
        stats = found.join(wall, at, "left").groupBy("hole").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.coalesce("_w", F.lit(0.0))).alias("_s"))
        small = stats.where((F.col("_n") < (most if most is not None else 1 << 62)) & (F.col("_s") < wall_share)).select("hole")
        found = found.join(small, "hole", "left_semi")
    return cells.select(*at).unionByName(found.select(*at)).distinct()


def interior(barrier: DataFrame, floor_seen: DataFrame, free: DataFrame, res: float, furniture: float = 6.0) -> DataFrame:
    """Inner cells of a plan: floor seen, or passed by two rays or more, closed and without the widened barrier; furniture-sized holes filled; then opened.

    `barrier` (i, j), `floor_seen` (i, j), `free` (i, j, n). What lies outside the raster is empty.
    """
    wall = dilate(barrier.select("i", "j"))
    seen = floor_seen.select("i", "j").unionByName(free.where("n >= 2").select("i", "j")).distinct()
    inside = cut(closed(seen, SQUARE, 2).join(wall, ["i", "j"], "left_anti"))
    filled = fill_holes(inside, most=int(furniture / (res * res) + 0.999999), barrier=barrier)
    return opened(cut(filled), SQUARE)


def drawn(segments: DataFrame, res: float, half_width: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j): cells of straight segments (x1, z1, x2, z2) drawn with a square brush, by samples half a cell apart."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("z2") - F.col("z1"))
    n = F.greatest(F.lit(2), F.ceil(length / (res * 0.5)).cast("int"))
    rows = segments.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = F.col("_k") / (F.col("_n") - 1)
    spots = rows.select(*keys, F.floor((F.col("x1") + (F.col("x2") - F.col("x1")) * t) / res).alias("i"), F.floor((F.col("z1") + (F.col("z2") - F.col("z1")) * t) / res).alias("j")).distinct()
    return dilate(spots, [(a, b) for a in range(-half_width, half_width + 1) for b in range(-half_width, half_width + 1)], keys)


def consensus_edges(labels: DataFrame) -> DataFrame:
    """(x, y): neighbouring cells that most runs (run, i, j, label) put in one label: strictly more runs with equal labels than half of those that have both."""
    steps = F.array(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")))
    a = labels.select("run", "label", _ident().alias("x"), "i", "j", F.explode(steps).alias("d")).select("run", F.col("label").alias("la"), "x", (F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j"))
    pairs = a.join(labels.select("run", "i", "j", F.col("label").alias("lb"), _ident().alias("y")), ["run", "i", "j"])
    votes = pairs.groupBy("x", "y").agg(F.count_if(F.col("la") == F.col("lb")).alias("same"), F.count(F.lit(1)).alias("n"))
    return votes.where("same * 2 > n").select("x", "y")


def consensus_labels(labels: DataFrame) -> DataFrame:
    """(i, j, component) of cells labelled in several runs: joined where most runs agree; the component is its least cell's id."""
    nodes = labels.select("i", "j", _ident().alias("node")).distinct()
    return nodes.join(components(nodes, consensus_edges(labels)), "node").select("i", "j", "component")


def best_shift(a: DataFrame, b: DataFrame, reach: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, di, dj, both, overlap): the shift of b's cells by at most `reach` cells that covers most of a's; overlap is the common part over the smaller raster.

    The exact discrete correlation: each cell of b votes for the shifts that bring it onto a cell of
    a, so the work is b's cells times (2 reach + 1)^2 and is counted by partial sums. The first of
    equal shifts by size, then in order.
    """
    span = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    moved = b.select(*keys, "i", "j", F.explode(_offsets(span)).alias("d")).select(*keys, (F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j"), F.col("d.a").alias("di"), F.col("d.b").alias("dj"))
    counts = moved.join(a.select(*keys, "i", "j"), [*keys, "i", "j"]).groupBy(*keys, "di", "dj").agg(F.count(F.lit(1)).alias("both"))
    sizes = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((a, "_a"), (b, "_b"))]
    best = Window.partitionBy(*keys).orderBy(F.desc("both"), F.abs("di") + F.abs("dj"), "di", "dj")
    rows = counts.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    for s in sizes:
        rows = rows.join(s, list(keys)) if keys else rows.crossJoin(F.broadcast(s))
    return rows.select(*keys, "di", "dj", "both", (F.col("both") / F.least("_a", "_b")).alias("overlap"))


def sharpness(pixels: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """(keys, n, sharpness): the variance of the Laplacian over the pixels (keys, i, j, value) that have all four neighbours."""
    weighted = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(-4.0 if (a, b) == (0, 0) else 1.0).alias("w")) for a, b in CROSS]))
    sums = pixels.select(*keys, "i", "j", value, weighted.alias("d")).groupBy(*keys, (F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j")).agg(F.sum(F.col(value) * F.col("d.w")).alias("lap"), F.count(F.lit(1)).alias("_n"))
    return sums.where("_n = 5").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_pop("lap").alias("sharpness"))


def covered_boxes(mask: DataFrame, cuts_x: list[float], cuts_z: list[float], res: float, least: float = 0.5) -> DataFrame:
    """(x0, z0, x1, z1) of the cells of a complex of lines that the mask (i, j) covers to `least` or more: raster cells by their centres, counted by cell of the complex."""
    def place(c, cuts):
        return F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]), lambda x: x <= c)) - 1

    at = mask.select(((F.col("i") + 0.5) * res).alias("x"), ((F.col("j") + 0.5) * res).alias("z")).select(place(F.col("x"), cuts_x).alias("a"), place(F.col("z"), cuts_z).alias("b"))
    inside = at.where(F.col("a").between(0, len(cuts_x) - 2) & F.col("b").between(0, len(cuts_z) - 2)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    pick = lambda cuts, k: F.element_at(F.array(*[F.lit(float(x)) for x in cuts]), k)
    boxes = inside.select("a", "b", pick(cuts_x, F.col("a") + 1).alias("x0"), pick(cuts_z, F.col("b") + 1).alias("z0"), pick(cuts_x, F.col("a") + 2).alias("x1"), pick(cuts_z, F.col("b") + 2).alias("z1"), "n")
    return boxes.where(F.col("n") * res * res >= (F.col("x1") - F.col("x0")) * (F.col("z1") - F.col("z0")) * least)


def outline(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i1, j1, i2, j2): unit edges around cells, with the cells on their left (counter-clockwise outlines, clockwise holes)."""
    sides = [((0, -1), (0, 0), (1, 0)), ((1, 0), (1, 0), (1, 1)), ((0, 1), (1, 1), (0, 1)), ((-1, 0), (0, 1), (0, 0))]
    each = F.explode(F.array(*[F.struct(F.lit(n[0]).alias("ni"), F.lit(n[1]).alias("nj"), *[F.lit(v).alias(k) for k, v in zip(("a", "b", "c", "e"), (*p, *q), strict=True)]) for n, p, q in sides]))
    rows = cells.select(*keys, "i", "j").distinct().withColumn("s", each).withColumn("_i", F.col("i") + F.col("s.ni")).withColumn("_j", F.col("j") + F.col("s.nj"))
    there = cells.select(*keys, F.col("i").alias("_i"), F.col("j").alias("_j")).distinct()
    free = rows.join(there, [*keys, "_i", "_j"], "left_anti")
    return free.select(*keys, (F.col("i") + F.col("s.a")).alias("i1"), (F.col("j") + F.col("s.b")).alias("j1"), (F.col("i") + F.col("s.c")).alias("i2"), (F.col("j") + F.col("s.e")).alias("j2"))


def traced(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ring, k, i, j): outlines put together to rings of corners, straight runs as one edge. A key's outline (one room's) is held at a time.

    Where four edges meet the ring turns right, so cells that touch at a corner stay apart. Keys are dealt to 64 tasks, which read them in order.
    """
    import pandas as pd

    def trace(rows: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        after: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for e in rows:
            after.setdefault(e[:2], []).append(e[2:])
        out = []
        ring = 0
        for start in sorted(after):
            while start in after:
                at, step, corners = start, None, []
                while True:
                    options = after[at]
                    turn = (lambda p: (step[0] * (p[1] - at[1]) - step[1] * (p[0] - at[0]))) if step else (lambda p: 0)
                    to = max(options, key=turn)  # a left turn keeps cells that touch at a corner apart
                    options.remove(to)
                    if not options:
                        del after[at]
                    new = (to[0] - at[0], to[1] - at[1])
                    if new != step:
                        corners.append(at)
                    step, at = new, to
                    if at == start:
                        break
                if len(corners) > 1 and (corners[1][0] - corners[0][0] == 0) == (step[0] == 0) and (corners[1][1] - corners[0][1] == 0) == (step[1] == 0):
                    corners = corners[1:]  # the first corner lies on a straight run
                out += [(ring, n, *c) for n, c in enumerate(corners)]
                ring += 1
        return out

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def rings(rows: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
            values = list(rows[["i1", "j1", "i2", "j2"]].itertuples(index=False, name=None))
            found = [(a, c) for a, b in zip(starts, [*starts[1:], len(rows)], strict=True) for c in trace(values[a:b])]
            own = rows[list(by)].iloc[[a for a, _ in found]].reset_index(drop=True)
            return pd.concat([own, pd.DataFrame([c for _, c in found], columns=["ring", "k", "i", "j"])], axis=1)

        for batch in batches:
            both = batch if held is None else pd.concat([held, batch], ignore_index=True)
            starts = both["_new"].to_numpy().nonzero()[0].tolist()
            if len(starts) > 1:
                yield rings(both.iloc[: starts[-1]], starts[:-1])
            held = both.iloc[starts[-1] :].reset_index(drop=True) if starts else None
        if held is not None:
            yield rings(held, [0])

    by = keys or ("_all",)
    rows = edges if keys else edges.withColumn("_all", F.lit(True))
    order = [*by, "i1", "j1", "i2", "j2"]
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order[len(by) :])) == 1
    rows = rows.select(*order).repartition(64, *by).withColumn("_new", first).sortWithinPartitions(*order)
    types = dict(rows.dtypes)
    return rows.mapInPandas(read, ", ".join([*(f"{k} {types[k]}" for k in by), "ring int, k int, i long, j long"])).select(*keys, "ring", "k", "i", "j")
