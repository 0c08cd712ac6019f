"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text: maximal runs of characters other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """Target of each source: weights shared out under a cap, the excess dealt again by weight.

    `totals` has a row (source, source_size, n_docs) for each source; it is the dimension of the
    mix, not its documents. Sources are taken by code point, null last, and `weights` repeat over
    them. With sources ordered by cap / weight the capped ones are a prefix, so running sums find
    the level that repeated resharing converges to. Adds `weight` and `target`.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy((F.col("most") / F.col("weight")), F.col("place"))
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(w) for w in weights])
    return (
        totals.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("capped", F.coalesce(F.sum("most").over(earlier), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
        .withColumn("free", F.col("weight") * F.col("level") <= F.col("most"))
        .withColumn("common", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(ordered))
        .withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * F.col("common"), F.col("most").cast("double"))))
        .select("source", "source_size", "n_docs", "place", "weight", "target")
    )


def highest_quotients(rows: DataFrame, keys: tuple[str, ...], target: str, house: Column, most: int | None = None, limit: Column | None = None) -> DataFrame:
    """Adds `seats`: of each key's house the highest quotients target / (2 seats + 1) win; ties to the smaller `place`.

    `base` is each row's rounded share, which has the seats whose quotient passes the common
    divisor. The seats over or missing (about the root of the number of rows) are settled by ranking
    quotients, of up to `most` seats a row; `limit` is the most that a row can take. The seats of a key
    add up to its house, except where the limits leave too few.
    """
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    first = rows.withColumn("due", (house - F.sum("base").over(every)).cast("long"))
    n = F.abs("due")
    tried = n if most is None else F.least(n, F.lit(most).cast("long"))
    candidates = first.where(n > 0).select(*keys, "place", "due", target, "base", *([limit.alias("_limit")] if limit is not None else []), F.explode(F.sequence(F.lit(0).cast("long"), tried - 1)).alias("j"))
    seat = F.when(F.col("due") > 0, F.col("base") + F.col("j")).otherwise(F.col("base") - 1 - F.col("j"))
    candidates = candidates.withColumn("seat", seat).where("seat >= 0").withColumn("quotient", F.col(target) / (F.col("seat") * 2 + 1))
    if limit is not None:
        candidates = candidates.where((F.col("due") < 0) | (F.col("seat") < F.col("_limit")))
    best = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy(F.when(F.col("due") > 0, -F.col("quotient")).otherwise(F.col("quotient")), "place", "j")
    moved = candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.abs("due")).groupBy(*keys, "place").agg(F.sum(F.signum("due").cast("long")).alias("moved"))
    return first.join(moved, [*keys, "place"], "left").withColumn("seats", F.col("base") + F.coalesce("moved", F.lit(0))).drop("base", "due", "moved")


def block_seats(targets: DataFrame, block: int) -> DataFrame:
    """Blocks of `block` words for each source, out of a house of sum(target) / block seats, rounded. Adds `seats`. The rows are sources, a dimension."""
    rows = targets.withColumn("base", F.floor(F.col("target") / block + 0.5).cast("long"))
    return highest_quotients(rows, (), "target", F.floor(F.sum("target").over(Window.partitionBy(F.lit(1))) / block + 0.5))


def shard_quotas(lengths: DataFrame, block: int, cap: int) -> DataFrame:
    """(source_place, place, length, blocks, seats) of each source's shards (source_place, place, length, source_seats, source_size): the source's seats go to its shards by the same rule, so that quotas add up to it; a shard gives each of its blocks `cap` times at most."""
    rows = lengths.withColumn("blocks", F.greatest(F.ceil(F.col("length") / block), F.lit(1)).cast("long"))
    share = F.col("source_seats") * F.col("length") / F.greatest(F.col("source_size"), F.lit(1))
    rows = rows.withColumn("base", F.least(F.floor(share + 0.5).cast("long"), F.col("blocks") * cap))
    return highest_quotients(rows, ("source_place",), "length", F.col("source_seats"), 3, F.col("blocks") * cap).select("source_place", "place", "length", "blocks", "seats")


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, block: int = 16, docs_per_shard: int = 1024, most_shards: int = 65536, seed: int = 0,
) -> DataFrame:
    """Words that a mix of `share` times the corpus takes from each document.

    Every source's documents are dealt by a seeded hash to shards of about `docs_per_shard`
    documents, so that a source with a third of all rows is spread over many tasks. A source's
    seats go to its shards by the same rule, as integer quotas that add up to them. Within a shard documents
    follow a seeded order and their words form blocks of `block` words; a quota of q over n blocks
    takes every block q // n times and the first q % n blocks once more.

    Returns (id, source, size, source_size, target, taken). Null or blank texts have size 0 and are
    taken 0 times; a null source is a source of its own; repeated rows count as they are (equal rows
    may swap their `taken`); an empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = saved(rows, "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = block_seats(source_targets(totals, weights, share, cap), block).withColumn(
        "n_shards", F.least(F.ceil(F.col("n_docs") / docs_per_shard), F.lit(most_shards)).cast("long")
    )
    plan = plan.withColumnsRenamed({"source": "p_source"})
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = (
        rows.join(small(plan), F.col("source").eqNullSafe(F.col("p_source")))
        .withColumn("place_in", place)
        .withColumn("shard", F.conv(F.substring("place_in", 1, 8), 16, 10).cast("long") % F.col("n_shards"))
    )
    lengths = rows.groupBy(F.col("place").alias("source_place"), F.col("shard").alias("place")).agg(F.sum("size").alias("length"), F.first("seats").alias("source_seats"), F.first("source_size").alias("source_size"))
    quotas = small(shard_quotas(lengths, block, cap).select(F.col("source_place").alias("q_source"), F.col("place").alias("q_shard"), "blocks", F.col("seats").alias("quota")))
    order = Window.partitionBy("place", "shard").orderBy("place_in", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stop", F.sum("size").over(order)).join(quotas, (F.col("place") == F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    start = F.col("stop") - F.col("size")
    times, more = F.floor(F.col("quota") / F.col("blocks")), (F.col("quota") % F.col("blocks")) * block
    part = F.greatest(F.lit(0), F.least(F.col("stop"), more) - start)
    return rows.select(
        F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (times * F.col("size") + part).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document repeated as often as the mix takes it, to the nearest whole number.

    Same columns as `docs`. Documents of which the mix takes less than half their words go: a quota ends inside one document of each shard.
    """
    id_col = options.get("id_col", "doc_id")
    taken = mix_sources(docs, **options)
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    # repeated ids: one decision for each id, by the sum of what its rows take
    taken = taken.groupBy(F.col(id_col).alias("_id")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).where("taken > 0").select("_id", copies.alias("_copies")).where("_copies > 0")
    taken = small(taken)
    kept = docs.join(taken, docs[id_col].eqNullSafe(taken["_id"]))
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[docs[c] for c in docs.columns])
