"""Exact distances to the border of a mask, and regions divided at their necks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grids import boundary_lengths, cell_components, cut, grow


def border_distances(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, d2): the squared distance, in cells, from each cell of a mask to the nearest cell outside it; exact.

    In two passes. Along a row the nearest outside cell ends the cell's run, which windows find.
    Along a column the distance is the least of (i - k)**2 + row distance of k squared, over the cells
    k of the cell's own run in the column and its two ends, as nothing beyond an end is nearer. That is
    a lower envelope of parabolas, found in one pass over the run. Runs are groups; none is longer than
    the mask is high.
    """
    import numpy as np
    import pandas as pd

    def runs_of(df: DataFrame, line: str, at: str) -> DataFrame:
        order = Window.partitionBy(*keys, line).orderBy(at)
        begins = F.coalesce(F.col(at) - F.lag(at).over(order) != 1, F.lit(True))
        return df.withColumn("_new", F.when(begins, F.col(at))).withColumn("_run", F.last("_new", ignorenulls=True).over(order)).drop("_new")

    rows = runs_of(cells.select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct(), "i", "j")
    run = Window.partitionBy(*keys, "i", "_run")
    rows = rows.select(*keys, "i", "j", F.least(F.col("j") - F.col("_run") + 1, F.max("j").over(run) - F.col("j") + 1).alias("g"))
    columns = runs_of(rows, "j", "i")

    def envelope(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        at = np.concatenate([[part["i"].iloc[0] - 1], part["i"].to_numpy(), [part["i"].iloc[-1] + 1]]).astype(float)
        low = np.concatenate([[0.0], part["g"].to_numpy(float) ** 2, [0.0]])
        kept, starts = [0], [-np.inf]
        for k in range(1, len(at)):
            while True:
                last = kept[-1]
                meet = ((low[k] + at[k] ** 2) - (low[last] + at[last] ** 2)) / (2 * (at[k] - at[last]))
                if meet > starts[-1]:
                    break
                kept.pop()
                starts.pop()
            kept.append(k)
            starts.append(meet)
        own = at[1:-1]
        nearest = np.array(kept)[np.searchsorted(np.array(starts), own, "right") - 1]
        return part[[*keys, "i", "j"]].assign(d2=((own - at[nearest]) ** 2 + low[nearest]).round().astype(np.int64))

    types = dict(cells.dtypes)
    form = ", ".join([*(f"{k} {types[k]}" for k in keys), "i long, j long, d2 long"])
    return columns.groupBy(*keys, "j", "_run").applyInPandas(envelope, form)


def split_at_necks(labels: DataFrame, res: float, *, core: float = 0.45, door: float = 1.3, least_core: float = 0.3, least_room: float = 1.5) -> DataFrame:
    """(i, j, label, part): regions (i, j, label) divided where they are narrow, as parts numbered from 1 in each region by their core's first cell.

    Cells farther than `core` from the region's border form cores; cores of `least_core` m2 or more
    grow back over their region. Two parts are one room where the border between them is wider than
    `door`, the widest first; then a part under `least_room` joins the neighbour with which it has the
    longest border. Distances, cores, growth and borders are joins over all regions; what joins what is
    decided on the graph of a region's parts.
    """
    import pandas as pd

    # regions are kept apart by rows of their own, so that cores and growth of all go on together
    spans = labels.groupBy("label").agg(F.min("i").alias("_i0"), (F.max("i") - F.min("i") + 3).alias("_h"))
    shift = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)  # over regions
    spans = spans.select("label", (F.coalesce(F.sum("_h").over(shift), F.lit(0)) - F.col("_i0")).alias("_di"))
    apart = cut(labels.join(F.broadcast(spans), "label").select("label", "_di", (F.col("i") + F.col("_di")).cast("long").alias("i"), F.col("j").cast("long").alias("j")))
    deep = border_distances(apart.select("i", "j")).where(F.sqrt(F.col("d2").cast("double")) * res > core)
    cores = cut(cell_components(deep))
    big = cores.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * res * res >= least_core)
    marks = cores.join(big, "component").select("i", "j", (-F.col("component")).alias("label"))  # of two that meet the earlier core wins
    grown = cut(grow(marks, apart).select("i", "j", (-F.col("label")).alias("part")))
    whole = cut(apart.join(grown, ["i", "j"], "left").withColumn("part", F.coalesce("part", F.lit(-1).cast("long"))))
    sizes = whole.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")).select("label", F.col("part").alias("a"), F.lit(None).cast("long").alias("b"), "n")
    owner = whole.select(F.col("part").alias("a"), "label").distinct()
    borders = boundary_lengths(grown.withColumnRenamed("part", "label")).join(owner, "a").select("label", "a", "b", "n")

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        alone = part[part["b"].isna()]
        area = {int(a): n * res * res for a, n in zip(alone["a"], alone["n"], strict=True)}
        into = {a: a for a in area}
        width = {(int(a), int(b)): int(n) for a, b, n in part[part["b"].notna()][["a", "b", "n"]].itertuples(index=False)}

        def take(keep: int, gone: int) -> None:
            area[keep] += area.pop(gone)
            into.update({p: keep for p, q in into.items() if q == gone})
            for (a, b), n in [x for x in width.items() if gone in x[0]]:
                del width[a, b]
                other = b if a == gone else a
                if other != keep:
                    pair = (min(keep, other), max(keep, other))
                    width[pair] = width.get(pair, 0) + n

        while len(area) > 1:
            wide = max(((n, pair) for pair, n in width.items() if n * res > door), default=None)
            if wide:
                take(*wide[1])
                continue
            near = {a: max(((n, y if x == a else x) for (x, y), n in width.items() if a in (x, y)), default=None) for a in sorted(area) if area[a] < least_room}
            small = next((a for a, x in near.items() if x), None)
            if small is None:
                break
            take(near[small][1], small)
        number = {a: k for k, a in enumerate(sorted(area), 1)}
        return pd.DataFrame({"label": part["label"].iloc[0], "part": list(into), "room": [number[q] for q in into.values()]})

    rooms = sizes.unionByName(borders).groupBy("label").applyInPandas(joined, f"label {dict(labels.dtypes)['label']}, part long, room int")
    return whole.join(rooms, ["label", "part"]).select((F.col("i") - F.col("_di")).alias("i"), "j", "label", F.col("room").alias("part"))
