"""Joins that a plain equality can't express: ranges, neighbours, as-of, greedy one-to-one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def near_join(left: DataFrame, right: DataFrame, lc: str, rc: str, reach: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with |left.lc - right.rc| <= reach and equal keys: an equality join on cells of `reach`, the right side in three cells, then the exact test."""
    a = left.withColumn("_cell", F.floor(F.col(lc) / reach))
    b = right.withColumn("_cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(rc) / reach) + d)))
    return a.join(b, [*keys, "_cell"]).where(F.abs(F.col(lc) - F.col(rc)) <= reach).drop("_cell")


def near_join_of_values(left: DataFrame, right: DataFrame, lc: str, rc: str, reach: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """`near_join` where values repeat: only distinct values of a key are compared, and rows then meet the rows of the values near their own, so every pair that is made is one of the result. Rows are dealt by key and value: few bytes make many pairs, and one task would get them all."""
    near = near_join(left.select(*keys, F.col(lc).alias("_l")).distinct(), right.select(*keys, F.col(rc).alias("_r")).distinct(), "_l", "_r", reach, keys)
    asked = left.withColumn("_l", F.col(lc)).join(near, [*keys, "_l"]).drop("_l").repartition(64, *keys, "_r")
    return asked.join(right.withColumn("_r", F.col(rc)).repartition(64, *keys, "_r").hint("merge"), [*keys, "_r"]).drop("_r")


def overlap_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], width: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of intervals that overlap, with `overlap`; both sides enter the cells of `width` they touch, and a pair is taken in the first cell they share."""
    def spread(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))

    pairs = spread(left, *a).join(spread(right, *b), [*keys, "_cell"])
    start, stop = F.greatest(F.col(a[0]), F.col(b[0])), F.least(F.col(a[1]), F.col(b[1]))
    return pairs.where((stop > start) & (F.floor(start / width) == F.col("_cell"))).withColumn("overlap", stop - start).drop("_cell")


def not_covered(gaps: DataFrame, solid: DataFrame, gap: tuple[str, str], seg: tuple[str, str], ident: list[str], width: float, keys: tuple[str, ...] = (), slack: float = 0.05) -> DataFrame:
    """Gaps that no solid interval enters by more than `slack`: an anti-join on the identity of gaps that one enters."""
    inner = gaps.withColumn("_in", F.col(gap[0]) + slack).withColumn("_out", F.col(gap[1]) - slack).where("_out > _in")
    hit = overlap_join(inner.select(*keys, *[c for c in ident if c not in keys], "_in", "_out"), solid, ("_in", "_out"), seg, width, keys).select(*ident).distinct()
    return gaps.join(hit, ident, "left_anti")


def next_stop(ends: DataFrame, stops: DataFrame, at: str, stop: str, keys: tuple[str, ...], beyond: float = 0.0) -> DataFrame:
    """Adds `next`: the least stop more than `beyond` above a row's value, by one sorted window over both (as-of forward)."""
    rows = ends.withColumn("_p", F.col(at) + beyond).withColumn("_s", F.lit(None).cast("double"))
    marks = stops.select(*keys, F.col(stop).alias("_p"), F.col(stop).cast("double").alias("_s")).withColumn("_mark", F.lit(1))
    both = rows.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_p"), "_mark").rowsBetween(Window.unboundedPreceding, -1)  # backwards: a growing frame costs one step a row
    return both.withColumn("next", F.last("_s", ignorenulls=True).over(ahead)).where("_mark = 0").drop("_p", "_s", "_mark")


def nearest_anchor(rows: DataFrame, anchors: DataFrame, at: str, anchor: str, keys: tuple[str, ...], reach: float) -> DataFrame:
    """Adds `anchor` and signed `offset`: the nearest anchor closer than `reach`; of two equally near ones the upper."""
    marks = anchors.select(*keys, F.col(anchor).cast("double").alias("_p")).withColumn("_m", F.col("_p"))
    both = rows.withColumn("_p", F.col(at).cast("double")).withColumn("_m", F.lit(None).cast("double")).withColumn("_row", F.lit(1)).unionByName(marks.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    forth, back = Window.partitionBy(*keys).orderBy("_p", "_row"), Window.partitionBy(*keys).orderBy(F.desc("_p"), F.desc("_row"))  # growing frames both ways
    below, above = (F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for w in (forth, back))
    found = both.withColumn("_below", below).withColumn("_above", above).where("_row = 1")
    lower = F.col("_above").isNull() | ((F.col("_p") - F.col("_below")) < (F.col("_above") - F.col("_p")))
    found = found.withColumn("anchor", F.when(F.col("_below").isNotNull() & lower, F.col("_below")).otherwise(F.col("_above")))
    found = found.withColumn("offset", F.col("_p") - F.col("anchor"))
    return found.withColumn("anchor", F.when(F.abs("offset") < reach, F.col("anchor"))).withColumn("offset", F.when(F.col("anchor").isNotNull(), F.col("offset"))).drop("_p", "_m", "_row", "_below", "_above")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest_vectors(queries: DataFrame, candidates: DataFrame, ident: str, vector: str, k: int, *, block: int = 2048) -> DataFrame:
    """(ident, rank, other, d2): the k nearest candidates of a stated query set by exact L2 distance, itself excluded.

    Candidates and queries are dealt to blocks by a hash, and a task holds one block of each: products of matrices tell which
    candidates can be among a query's k nearest, whose distances are then added up exactly. Each pair of blocks gives these to the
    merge. Blocks of candidates grow where there were hundreds of them, so that few copies of the queries move. Vectors of different
    lengths do not meet; a null vector or one with a null takes no part.
    """
    whole = lambda df: df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()) & (F.size(vector) > 0))
    size = candidates.count()
    n, m = max(1, -(-size // block) if size <= 96 * block else max(96, -(-size // (8 * block)))), max(1, -(-queries.count() // (4 * block)))
    dealt = lambda by, of: F.pmod(F.xxhash64(by), F.lit(of)).cast("int")
    a = whole(queries).select(F.col(ident).alias("q"), F.col(vector).cast("array<double>").alias("_a"), F.size(vector).alias("_size"), dealt(ident, m).alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_block"))
    b = whole(candidates).select(F.col(ident).alias("other"), F.col(vector).cast("array<double>").alias("_b"), F.size(vector).alias("_size"), dealt(ident, n).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("_part"))
    types = dict(candidates.dtypes)

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        one, two = (t[c].combine_chunks() for t, c in ((left, "_a"), (right, "_b")))
        width = len(two[0]) if len(two) else 1
        x, y = (v.flatten().to_numpy().reshape(-1, width) for v in (one, two))
        rows, columns, apart = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
        for at in range(0, len(x) if len(y) else 0, 256):
            some = x[at : at + 256]
            about = (some * some).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * some @ y.T
            slack = 1e-8 + 1e-11 * ((some * some).sum(axis=1) + (y * y).sum(axis=1).max())
            last = np.partition(about, min(k, len(y) - 1), axis=1)[:, min(k, len(y) - 1)]  # one more than k: the query itself
            r, c = np.nonzero(~(about > (last + slack)[:, None]))
            d2 = np.zeros(len(r))
            for d in range(width):
                d2 += (some[r, d] - y[c, d]) * (some[r, d] - y[c, d])
            rows.append(r + at)
            columns.append(c)
            apart.append(d2)
        return pa.table({"q": left["q"].take(pa.array(np.concatenate(rows))), "other": right["other"].take(pa.array(np.concatenate(columns))), "d2": pa.array(np.concatenate(apart))})

    met = a.groupBy("_block", "_part", "_size").cogroup(b.groupBy("_block", "_part", "_size")).applyInArrow(nearest, f"q {types[ident]}, other {types[ident]}, d2 double")
    pairs = met.where("q <> other").select("q", "other", F.round("d2", 9).alias("d2"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d2", "other"))).where(F.col("rank") <= k).select(F.col("q").alias(ident), "rank", "other", "d2")


def ratio_match(nearest: DataFrame, ident: str, ratio: float) -> DataFrame:
    """Queries whose nearest candidate is clearly nearer than the second: d1 < ratio * d2."""
    two = nearest.where("rank <= 2").groupBy(ident).agg(
        F.max(F.when(F.col("rank") == 1, F.col("other"))).alias("match"), F.max(F.when(F.col("rank") == 1, F.sqrt("d2"))).alias("d1"), F.max(F.when(F.col("rank") == 2, F.sqrt("d2"))).alias("d2"))
    return two.where(F.col("d1") < F.col("d2") * ratio)


def shared_links(rows: DataFrame, group: str, ident: str, content: Column) -> DataFrame:
    """One link for each pair of groups that hold equal content: the first of each (content, group), by id; the first such content decides."""
    one = rows.select(F.col(group).alias("g"), F.col(ident).alias("id"), content.alias("h")).groupBy("h", "g").agg(F.min("id").alias("id"))
    a, b = (one.select("h", F.col("g").alias(f"group_{s}"), F.col("id").alias(f"id_{s}")) for s in "ab")
    pairs = a.join(b, "h").where("group_a < group_b")
    first = Window.partitionBy("group_a", "group_b").orderBy("id_a", "id_b")
    return pairs.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("group_a", "group_b", "id_a", "id_b")


def greedy_pairs(candidates: DataFrame, keys: tuple[str, ...], a: str, b: str, score: str, *, best_first: bool = True) -> DataFrame:
    """One-to-one pairs within a key, taken greedily: by descending score, or in the order of `a` with each taking its best free `b`.

    The order of taking matters, so a key's candidates (a room's walls, some tens) are read in order by one task, which
    remembers what of this key is taken. Keys follow each other in a task's rows, as many as there are.
    """
    best = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")).desc_nulls_last()
    order = [best, F.col(a).asc_nulls_last(), F.col(b).asc_nulls_last()] if best_first else [F.col(a).asc_nulls_last(), best, F.col(b).asc_nulls_last()]
    placed = candidates.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).sortWithinPartitions(*keys, "_k")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used_a, used_b = set(), set()
        for batch in batches:
            chosen = []
            for k, (n, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_k", a, b)), strict=True)):
                if n == 1:
                    used_a, used_b = set(), set()
                if x not in used_a and y not in used_b:
                    used_a.add(x)
                    used_b.add(y)
                    chosen.append(k)
            yield batch.take(pa.array(chosen, pa.int64()))

    return placed.mapInArrow(take, placed.schema).drop("_k")


def best_per_pair(rows: DataFrame, a: str, b: str, weight: str, tie: list[str]) -> DataFrame:
    """The heaviest row of each unordered pair; the first of equals by `tie`."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    w = Window.partitionBy(lo, hi).orderBy(F.desc(weight), *tie)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

