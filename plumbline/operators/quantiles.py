"""Exact percentiles of few keys with many rows: a sketch brackets the ranks, and only the bracketed values are ordered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grids import cut


def with_key_values(df: DataFrame, by_key: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """`df` with the columns that `by_key` has for its keys, null keys too; the planner chooses how to send them."""
    if not keys:
        return df.crossJoin(F.broadcast(by_key))  # one row
    a, b = df.alias("_l"), by_key.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], *[c for c in by_key.columns if c not in keys])
    meets = reduce(lambda x, y: x & y, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)])
    return a.join(b, meets).drop(*[f"_k{n}" for n in range(len(keys))])


def settled(by_key: DataFrame, most: int = 10_000) -> DataFrame:
    """`by_key` computed once, and sent to all tasks if it has at most `most` rows: else a join would deal all rows of a few large keys to a few tasks."""
    once = cut(by_key)
    return F.broadcast(once) if once.limit(most + 1).count() <= most else once


def exact_percentiles(df: DataFrame, keys: tuple[str, ...], value: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """(keys, p): an array of the percentiles, linearly interpolated, the same as `percentile` gives.

    `percentile` holds all distinct values of a key in one task. Here a sketch (partial sums of
    bounded size) gives two values around each rank; the rows below them are counted and those between
    them, about 4 / accuracy of a key, are counted by value and ordered. Null values are passed over;
    a null key is a key, and a key without values has nulls. A rank outside its two values, which the
    sketch's error bound excludes, is an error and not a wrong result.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    slack = 2.0 / accuracy
    ends = [x for s in shares for x in (max(0.0, s - slack), min(1.0, s + slack))]
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("_v", ends, accuracy).alias("_e"), F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    n = F.col("_n")
    spots = []
    for k, s in enumerate(shares):
        low = F.when((F.lit(s) <= slack) | (n <= 4 * accuracy), F.col("_lo")).otherwise(F.col("_e")[2 * k])
        high = F.when((F.lit(s) >= 1 - slack) | (n <= 4 * accuracy), F.col("_hi")).otherwise(F.col("_e")[2 * k + 1])
        spots.append(F.struct(F.lit(k).alias("_k"), low.alias("_a"), high.alias("_b"), F.when(n > 0, F.lit(s) * (n - 1)).alias("_at")))
    asked = settled(sketch.select(*keys, F.array(*spots).alias("_asked")))
    met = with_key_values(rows, asked, keys).select(*keys, "_v", F.explode("_asked").alias("s")).select(*keys, "_v", "s.*")
    below = F.col("_v") < F.col("_a")
    counts = met.where(F.col("_v").isNull() | (F.col("_v") <= F.col("_b"))).groupBy(*keys, "_k", "_at", F.when(~below, F.col("_v")).alias("_v")).agg(F.count("_v").alias("_c"))
    order = Window.partitionBy(*keys, "_k").orderBy(F.col("_v").asc_nulls_first())
    ranked = counts.withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first, after = F.floor("_at"), F.ceil("_at")
    holds = lambda r: (F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r)
    ends = ranked.groupBy(*keys, "_k", "_at").agg(F.max(F.when(holds(first), F.col("_v"))).alias("_a"), F.max(F.when(holds(after), F.col("_v"))).alias("_b"))
    between = F.when(F.col("_at").isNull(), F.lit(None).cast("double")).when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
    between = between.when(first == after, F.col("_a")).otherwise((after - F.col("_at")) * F.col("_a") + (F.col("_at") - first) * F.col("_b"))
    return ends.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", between.alias("p")))), lambda x: x["p"]).alias("p"))
