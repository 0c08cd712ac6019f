"""Operators on ordered rows: islands, chains, paths, chunks, key frames, interpolation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(df: DataFrame, along: str, keys: tuple[str, ...], *, res: float, min_occ: int = 2, close_gap: float = 0.12, min_seg: float = 0.2) -> DataFrame:
    """Occupied stretches (keys, a, b): bins of `res` from the key's least value with min_occ rows or more, runs joined over gaps up to close_gap, and min_seg long at least."""
    low = df.groupBy(*keys).agg(F.min(along).alias("lo"))
    bins = df.join(low, list(keys)).groupBy(*keys, "lo", F.floor((F.col(along) - F.col("lo")) / res).alias("bin")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_occ)
    w = Window.partitionBy(*keys).orderBy("bin")
    gap = (F.col("bin") - F.lag("bin").over(w) - 1) * res
    rows = bins.withColumn("_new", F.when(gap.isNull() | (F.round(gap, 9) > close_gap), 1).otherwise(0)).withColumn("island", F.sum("_new").over(w))
    ends = rows.groupBy(*keys, "island", "lo").agg(F.min("bin").alias("i"), F.max("bin").alias("j"))
    ends = ends.select(*keys, (F.col("lo") + F.col("i") * res).alias("a"), (F.col("lo") + (F.col("j") + 1) * res).alias("b"), ((F.col("j") + 1 - F.col("i")) * res).alias("length"))
    return ends.where(F.round("length", 9) >= min_seg)


def chain_clusters(df: DataFrame, value: str, tie: str, keys: tuple[str, ...], gap: float) -> DataFrame:
    """Adds `cluster`: values in order stay together while each is less than `gap` above the one before."""
    w = Window.partitionBy(*keys).orderBy(value, tie)
    step = F.col(value) - F.lag(value).over(w)
    return df.withColumn("_new", F.when(step.isNull() | (step >= gap), 1).otherwise(0)).withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def path_length(df: DataFrame, coords: list[str], order: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Adds `step` and the running `path`; the first step of a key is 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    square = sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in coords), F.lit(0.0))
    return df.withColumn("step", F.coalesce(F.sqrt(square), F.lit(0.0))).withColumn("path", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def path_chunks(walked: DataFrame, order: list[str], keys: tuple[str, ...], *, length: float = 1.0, least: int = 6) -> DataFrame:
    """Adds `chunk`, numbered from 0: pieces of `length` along the path; a piece with fewer than `least` rows joins the piece before it, the first never."""
    rows = walked.withColumn("_c", F.floor(F.col("path") / length))
    sizes = rows.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_c")
    sizes = sizes.withColumn("_first", F.row_number().over(w) == 1).withColumn("_own", F.when(F.col("_first") | (F.col("_n") >= least), F.col("_c")))
    sizes = sizes.withColumn("_to", F.last("_own", ignorenulls=True).over(w)).withColumn("chunk", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_to")) - 1)
    return rows.join(sizes.select(*keys, "_c", "chunk"), [*keys, "_c"]).drop("_c")


def keyframes(df: DataFrame, keys: list[str], order: list[str], coords: list[str], heading: str, *, min_trans: float = 0.05, min_rot: float = 5.0, most: int | None = 1500) -> DataFrame:
    """Rows that moved min_trans, or turned min_rot degrees, from the last row that was kept.

    What is kept depends on what was kept before, so rows go in order through Arrow batches: they
    are range- and sort-merged by Spark (a key in one task, sorted there, spilling if it must), and
    the task holds one kept row a key. `most` keeps evenly spaced ones of them.
    """
    bound = math.cos(math.radians(min_rot))
    names = df.columns
    one = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        for rows in batches:
            keep = []
            for row in rows[[*keys, *coords, heading]].itertuples(index=False, name=None):
                key, at, turn = row[: len(keys)], row[len(keys) : -1], row[-1]
                new = last is None or last[0] != key or math.dist(last[1], at) > min_trans or math.cos(turn - last[2]) < bound
                keep.append(new)
                if new:
                    last = key, at, turn
            yield rows.loc[keep, names]

    kept = one.mapInPandas(run, df.schema)
    return kept if most is None else evenly(kept, keys, order, most)


def evenly(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most `most` rows of each key: rows k * (n - 1) / (most - 1), truncated. A sampling operator."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = df.withColumn("_n", n).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    k = F.ceil(F.col("_i") * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    picked = F.floor(k * (F.col("_n") - 1) / (most - 1)) == F.col("_i")
    return rows.where((F.col("_n") <= most) | picked).drop("_n", "_i")


def interpolate(samples: DataFrame, known: DataFrame, at: str, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Adds `value` to samples by straight lines between known (keys, at, value); beyond the ends the end's value. Samples and knots meet in one sorted window, not in a join of all pairs."""
    both = samples.withColumn("_v", F.lit(None).cast("double")).withColumn("_s", F.lit(1)).unionByName(
        known.select(*keys, at, F.col(value).alias("_v")).withColumn("_s", F.lit(0)), allowMissingColumns=True)
    back = Window.partitionBy(*keys).orderBy(at, "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("_s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    knot = F.when(F.col("_v").isNotNull(), F.struct(F.col(at).alias("t"), F.col("_v").alias("v")))
    rows = both.withColumn("_a", F.last(knot, ignorenulls=True).over(back)).withColumn("_b", F.last(knot, ignorenulls=True).over(ahead)).where("_s = 1")
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(at) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    exact = F.when(F.col("_a.t") == F.col(at), F.col("_a.v"))
    return rows.withColumn(value, F.coalesce(exact, line, F.col("_a.v"), F.col("_b.v"))).drop("_v", "_s", "_a", "_b")


def median5(df: DataFrame, value: str, order: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Adds `median5`: the median of five neighbours, ends repeated."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(ends), F.last(value).over(ends)
    five = F.array(*[F.coalesce(F.lag(value, k).over(w), first) for k in (2, 1)], F.col(value), *[F.coalesce(F.lead(value, k).over(w), last) for k in (1, 2)])
    return df.withColumn("median5", F.element_at(F.sort_array(five), 3))


def rank_names(df: DataFrame, kind: str, size: str, tie: str, names: Column) -> DataFrame:
    """Adds `name`: the kind's own count by descending size."""
    w = Window.partitionBy(kind).orderBy(F.desc(size), tie)
    return df.withColumn("place", F.row_number().over(w)).withColumn("name", F.concat_ws(" ", names, F.col("place").cast("string")))


def cyclic(df: DataFrame, value: str, order: str, keys: tuple[str, ...]) -> DataFrame:
    """Adds `before` and `after`: the neighbours of a value around a closed ring."""
    w = Window.partitionBy(*keys).orderBy(order)
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("before", F.coalesce(F.lag(value).over(w), F.last(value).over(ends))).withColumn("after", F.coalesce(F.lead(value).over(w), F.first(value).over(ends)))
