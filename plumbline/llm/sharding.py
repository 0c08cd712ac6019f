"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, subdivided ranges."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

_LOW = (1 << 31) - 1


def _range_of(key: Column, cuts: list[int]) -> Column:
    """Index of the range of `key` among sorted boundaries, by a search in two levels."""
    if not cuts:
        return F.lit(0)
    width = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    outer = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda c: c <= key))
    inner = F.array(F.array().cast("array<bigint>"), *[F.array(*[F.lit(x) for x in g]) for g in groups])
    return F.when(outer == 0, F.lit(0)).otherwise((outer - 1) * width + F.size(F.filter(F.element_at(inner, outer + 1), lambda c: c <= key)))


def _cuts(keys: list[int], ranges: int) -> list[int]:
    """Quantiles of a sorted sample. A boundary keeps a text's copies together, but where several fall into one text they divide it."""
    picked = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    whole = [k & ~_LOW for k in picked]
    return sorted({k if whole.count(k & ~_LOW) > 1 else k & ~_LOW for k in picked} | set(whole))


def _bisected(cuts: Column, key: Column) -> Column:
    """How many of a row's sorted `cuts` are not above its key, in as many steps as their number has bits."""

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["lo"] + at["hi"], 1)
        above = F.get(cuts, middle) <= key
        return F.when(at["lo"] >= at["hi"], at).when(above, F.struct((middle + 1).alias("lo"), at["hi"].alias("hi"))).otherwise(F.struct(at["lo"].alias("lo"), middle.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(cuts) + 1)).cast("int") + 1), start, halve, lambda at: at["lo"])


def shard_by_bytes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16,
    ranges: int = 256, sample: int = 16384, most_rows: int = 200_000, group_share: float = 0.05, seed: int = 0,
) -> DataFrame:
    """Deals documents into `shards` of nearly equal bytes, in the order of a key.

    The key is the text's CRC-32 and, below it, a hash of the id, so copies of a text are
    neighbours and a large group of copies can still be divided. A sample in which a row's chance
    follows its size (at most about `sample` keys, for the boundaries only) gives `ranges` quantile
    boundaries; a range with more than `most_rows` rows is divided again by a sample of its own.
    Exact bytes are then counted for each range, and a row's shard follows from its byte position
    in the order of keys. Copies of a text stay in one shard unless they make up more than
    `group_share` of a shard.

    Returns (id, size, text_crc32, shard, slot): size in UTF-8 bytes plus 1, slot gapless from 0 in
    each shard. A null text has size 1 and a null checksum; null ids and repeated rows are dealt as
    any row; an empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
    ).withColumn("key", F.coalesce("text_crc32", F.lit(0)) * F.lit(1 << 31) + F.xxhash64("doc_id").bitwiseAND(F.lit(_LOW)))
    rows = saved(rows, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 1
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "key", F.lit(seed)), 11) / F.lit(float(1 << 53))

    keys = sorted(r[0] for r in rows.where(chance < F.col("size") * F.lit(sample / total)).select("key").collect())
    rows = rows.withColumn("part", _range_of(F.col("key"), _cuts(keys, ranges)).cast("long"))

    # ranges that are too full: splitters from a denser sample of the range, at most one for each most_rows / 16 rows
    full = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_rows)
    dense = rows.join(full, "part").where(chance < F.lit(16.0 / most_rows)).groupBy("part").agg(F.sort_array(F.collect_list("key")).alias("found"))
    dense = dense.select("part", F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.size("found") / 16).cast("int"))), lambda i: F.get("found", F.least(i * 16, F.size("found")) - 1)).alias("inner"))
    if full.limit(1).count():
        rows = rows.join(dense, "part", "left").withColumn("part", F.col("part") * 65536 + F.when(F.col("inner").isNull(), 0).otherwise(_bisected(F.col("inner"), F.col("key")))).drop("inner")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, whose number is bounded
    offsets = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    offsets = offsets.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))

    order = Window.partitionBy("part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    copies = Window.partitionBy("part", "text_crc32")
    placed = (
        rows.withColumn("rank", F.row_number().over(order)).withColumn("stop", F.sum("size").over(order))
        .withColumn("group_bytes", F.sum("size").over(copies)).withColumn("group_stop", F.max("stop").over(copies))
        .join(offsets, "part")
    )
    fair = total / shards
    middle = F.when(F.col("group_bytes") <= group_share * fair, F.col("group_stop") - F.col("group_bytes") / 2).otherwise(F.col("stop") - F.col("size") / 2)
    placed = placed.select(
        "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("rank")).alias("position"),
        F.least(F.lit(shards - 1), F.floor((F.col("bytes_before") + middle) * shards / F.lit(float(total)))).cast("int").alias("shard"),
    )
    starts = placed.groupBy("shard").agg(F.min("position").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", (F.col("position") - F.col("start")).cast("long").alias("slot"))
