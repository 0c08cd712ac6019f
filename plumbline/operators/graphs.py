"""Spanning forests and values chained along trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grids import components, cut


def spanning_forest(nodes: DataFrame, edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """The maximum spanning forest of edges (edge, x, y, weight): heavier first, then the smaller edge id.

    Boruvka's rounds: every component takes its best edge to another one, and components merge. The
    order is total, so the forest is the one that taking edges one by one gives.
    """
    labels = cut(nodes.select("node").distinct().withColumn("component", F.col("node")))
    forest = None
    for _ in range(most_rounds):
        a, b = (labels.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in "xy")
        across = edges.join(a, "x").join(b, "y").where("cx <> cy")
        ends = across.select("edge", "x", "y", "weight", F.explode(F.array("cx", "cy")).alias("c"), "cx", "cy")
        best = Window.partitionBy("c").orderBy(F.desc("weight"), "edge")
        chosen = cut(ends.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("edge", "x", "y", "weight", "cx", "cy").distinct())
        if not chosen.limit(1).count():
            break
        forest = chosen.drop("cx", "cy") if forest is None else forest.unionByName(chosen.drop("cx", "cy"))
        merged = components(labels.select(F.col("component").alias("node")), chosen.select(F.col("cx").alias("x"), F.col("cy").alias("y")))
        labels = cut(labels.join(merged.withColumnsRenamed({"node": "_n", "component": "_c"}), F.col("component") == F.col("_n")).select("node", F.col("_c").alias("component")))
    return forest if forest is not None else edges.select("edge", "x", "y", "weight").where(F.lit(False))


def chain_ratios(forest: DataFrame, roots: DataFrame, ratio: str) -> DataFrame:
    """(node, root, value, hops): products of edge ratios along the tree from each root (value 1); against an edge's direction its inverse. One hop of all trees a round."""
    steps = forest.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col(ratio).alias("r")).unionByName(forest.select(F.col("y").alias("a"), F.col("x").alias("b"), (1 / F.col(ratio)).alias("r")))
    steps = cut(steps)
    known = cut(roots.select("node", F.col("node").alias("root"), F.lit(1.0).alias("value"), F.lit(0).alias("hops")))
    front = known
    while True:
        more = front.join(steps, front["node"] == steps["a"]).select(F.col("b").alias("node"), "root", (F.col("value") * F.col("r")).alias("value"), (F.col("hops") + 1).alias("hops"))
        front = cut(more.join(known.select("node"), "node", "left_anti"))
        if not front.limit(1).count():
            return known
        known = cut(known.unionByName(front))


def chain_scales(forest: DataFrame, roots: DataFrame, ratio: str, edge: tuple[float, float] = (0.25, 4.0), chained: tuple[float, float] = (0.3, 3.0)) -> DataFrame:
    """chain_ratios over the edges with a plausible ratio; a chained value that is not plausible counts as 1."""
    plausible = forest.where(F.col(ratio).between(*edge))
    return chain_ratios(plausible, roots, ratio).withColumn("value", F.when(F.col("value").between(*chained), F.col("value")).otherwise(1.0))


def smooth_chain(df: DataFrame, keys: tuple[str, ...], order: str, measured: str, weight: str, lam: float) -> DataFrame:
    """Adds `x`: the values that balance weighted measurements against the curvature of the chain.

    A key's chunks (about one a metre of path) are one group. The system has five diagonals and is solved as a band, in steps as many as chunks.
    """
    import numpy as np
    import pandas as pd

    def banded(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of a symmetric matrix with diagonals d0, d1 (next) and d2 (after next), by its factors L D L'."""
        k = len(d0)
        d, e, f = d0.tolist(), d1.tolist(), d2.tolist()
        y = b.tolist()
        for i in range(k):
            if i + 1 < k:
                l1 = e[i] / d[i]
                d[i + 1] -= l1 * e[i]
                y[i + 1] -= l1 * y[i]
                if i + 2 < k:
                    l2 = f[i] / d[i]
                    e[i + 1] -= l2 * e[i]
                    d[i + 2] -= l2 * f[i]
                    y[i + 2] -= l2 * y[i]
        x = [0.0] * k
        for i in reversed(range(k)):
            later = (e[i] * x[i + 1] if i + 1 < k else 0.0) + (f[i] * x[i + 2] if i + 2 < k else 0.0)
            x[i] = (y[i] - later) / d[i]
        return np.array(x)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        m, w = rows[measured].to_numpy(float), rows[weight].to_numpy(float)
        k = len(m)
        if k == 1:
            x = np.where(w > 0, m, 0.0)
        elif k == 2:
            x = np.where(w > 0, m, np.average(m, weights=w + 1e-9))
        else:
            d0, d1, d2 = np.zeros(k), np.zeros(k - 1), np.zeros(k - 2)
            for at, v in ((0, 1.0), (1, 4.0), (2, 1.0)):  # each second difference adds (1, -2, 1) times itself
                d0[at : k - 2 + at] += v
            for at in (0, 1):
                d1[at : k - 2 + at] -= 2.0
            d2 += 1.0
            x = banded(w + 1e-9 + lam * d0, lam * d1, lam * d2, w * m)
        return rows.assign(x=x)

    return df.groupBy(*keys).applyInPandas(solve, f"{', '.join(f'{c} {t}' for c, t in df.dtypes)}, x double")
