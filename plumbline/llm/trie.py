"""Prefix trie of conversations by Van Emde Boas recursion: sequences are cut at half depth again and again, all levels' parts side by side."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved
from .mixing import word_count

#: Name of the textless root; other names are 16 bytes of a hash.
ROOT = b""
#: Depths of a path that meet under one key of a join, as a power of two.
RUN = 6


def _name(*parts: Column) -> Column:
    """A 128-bit name of a sequence of names."""
    return F.unhex(F.md5(F.concat(*parts)))


def turns_of(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, token, words) of each row with a conv_id: the name of its (role, text), null as empty, and the text's words.

    Texts are named where they are read, so that no later exchange carries them.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    token = _name(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role.cast("binary"), text.cast("binary"))
    rows = conversations.where(F.col(conv_col).isNotNull())
    return rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), token.alias("token"), word_count(F.col(text_col)).alias("words"))


def numbered(turns: DataFrame) -> DataFrame:
    """Adds `at`, the place from 0 of each turn in its conversation: by turn (null first), ties by token.

    Rows are dealt out in ranges of (conversation, turn), so that a conversation of any length is
    numbered by many tasks; where one lies in several ranges, what its earlier ranges hold is added
    (two rows a range at most, hence the broadcast). Turns that tie in token too are interchangeable
    and are dealt apart by a hash of where they were read.
    """
    dealt = turns.withColumn("_apart", F.xxhash64(F.monotonically_increasing_id()))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(parts, F.col("conv_id"), F.col("turn").asc_nulls_first(), "token", "_apart")
    dealt = saved(dealt.withColumn("_range", F.spark_partition_id()).drop("_apart"), "trie-ranges")
    shares = dealt.groupBy("conv_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    edges = dealt.groupBy("_range").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
    edges = edges.select("_range", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("conv_id"))
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = shares.join(F.broadcast(edges), ["conv_id", "_range"]).select("conv_id", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_range", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "token")
    placed = dealt.withColumn("_at", F.row_number().over(order)).join(F.broadcast(before), ["conv_id", "_range"], "left")
    return placed.withColumn("at", F.col("_at") - 1 + F.coalesce("_before", F.lit(0))).drop("_at", "_range", "_before")


def kept_head(conv_id: Column) -> Column:
    """How many first turns a rebuilt conversation takes from its base: the CRC-32 of its decimal id, modulo 4."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame, *, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first h turns of conversation c - c % every, then c's own turns after its first h, with h = kept_head(c) up to `most`.

    Returns (conv_id, at, token, words) of their turns, numbered without gaps, and the table
    (conv_id) of all conversations, which has those left without a turn.
    """
    placed = saved(numbered(turns), "trie-turns")
    convs = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id")
    heads = placed.where((F.col("at") < most) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), F.col("at").alias("turn"), "token", "words")
    taken = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base").where(F.col("turn") < kept_head(F.col("conv_id")))
    own = placed.where(F.col("at") >= kept_head(F.col("conv_id"))).select("conv_id", (F.col("at") + most).alias("turn"), "token", "words")
    return numbered(own.unionByName(taken.select("conv_id", "turn", "token", "words"))).select("conv_id", "at", "token", "words"), convs


@dataclass
class Trie:
    """`nodes`: (node, parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens), null parents for the root. `paths`: (conv_id, depth, node) of every turn."""

    nodes: DataFrame
    paths: DataFrame


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def name_prefixes(turns: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, depth, node, parent, words): the name of each conversation's first `depth` turns, its parent's at odd depths; and the number of levels.

    Upwards, neighbouring blocks of 2**k turns are paired and named. Downwards, every part of 2**k
    depths is cut at half depth: the cut prefix is named by the part's own root and the block
    between them, and the upper and the lower half are parts of the next level. All parts of a
    level, of all conversations, are one join on (conversation, depth), and levels halve in size, so
    there are as many rounds as the deepest conversation's depth has bits and each turn is moved a
    few times. A name does not depend on the conversation in which it was found.
    """
    turns = saved(turns, "trie-rebuilt")
    deepest = turns.agg(F.max("at")).first()[0]
    levels = 0 if deepest is None else int(deepest + 1).bit_length()  # all depths lie below 2**levels
    blocks = [turns.select("conv_id", F.col("at").alias("block"), F.col("token").alias("name"))]
    for k in range(1, levels):
        left, right = (F.max(F.when(F.col("block") % 2 == side, F.col("name"))).alias(f"b{side}") for side in (0, 1))
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("block", 1).alias("up")).agg(left, right).where("b0 is not null and b1 is not null")
        blocks.append(saved(pairs.select("conv_id", F.col("up").alias("block"), _name(F.lit(b"+"), F.col("b0"), F.col("b1")).alias("name")), f"trie-blocks{k}"))
    roots = [turns.where("at = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"))]
    cuts = [turns.limit(0).select("conv_id", F.col("at").alias("depth"), F.col("token").alias("node"), F.col("token").alias("parent"))]
    for k in range(levels, 0, -1):
        half = 1 << k - 1
        above = blocks[k - 1].where(F.col("block") % 2 == 0).select("conv_id", (F.col("block") * half).alias("depth"), "name")
        named = _all(roots).join(above, ["conv_id", "depth"]).select("conv_id", (F.col("depth") + half).alias("depth"), _name(F.lit(b"/"), F.col("node"), F.col("name")).alias("node"), (F.col("node") if k == 1 else F.lit(None).cast("binary")).alias("parent"))
        cuts.append(saved(named, f"trie-cuts{k}"))
        roots.append(cuts[-1].drop("parent"))
    lengths = turns.select("conv_id", (F.col("at") + 1).alias("depth"), "words")
    paths = saved(_all(cuts).join(lengths, ["conv_id", "depth"]), "trie-paths")
    for table in [*blocks[1:], *cuts[1:], turns]:
        discard(table)
    return paths, levels


def graft_totals(own: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """(node, n_leaves, saved_tokens) over each node's subtree, from `own` (node, parent, depth, conv_id, n_leaves, saved_tokens) of each node but the root.

    Parts are grafted from the smallest upwards, all parts of a level at once: what the nodes below
    a cut hold inside the lower half is added to the cut prefix, and the cut prefix's total to the
    nodes above it in the upper half. Those are found on the path of the cut prefix's smallest
    member, in runs of 64 depths, so that a long path is no single key. A level adds at most one row
    for each turn of the input, and what it adds is aggregated before it is written.
    """
    held = own.select("node", "parent", "depth", "n_leaves", "saved_tokens")
    added: list[DataFrame] = []
    for k in range(2, levels + 1):
        half, whole = 1 << k - 1, 1 << k
        place = F.col("depth") % whole
        below = _all([held, *added]).where(place == half + 1).select(F.col("parent").alias("node"), F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("depth"), F.lit(0).cast("long").alias("own_leaves"), F.lit(0).cast("long").alias("own_saved"), "n_leaves", "saved_tokens")
        cut = own.where(place == half).select("node", "conv_id", "depth", F.col("n_leaves").alias("own_leaves"), F.col("saved_tokens").alias("own_saved"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        grafts = below.unionByName(cut).groupBy("node").agg(F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("own_leaves", "own_saved", "n_leaves", "saved_tokens")])
        grafts = saved(grafts, f"trie-grafts{k}")
        runs = F.sequence(F.shiftright(F.col("depth") - half, RUN), F.shiftright(F.col("depth") - 2, RUN))
        reach = grafts.select("conv_id", F.col("depth").alias("cut"), (F.col("own_leaves") + F.col("n_leaves")).alias("n_leaves"), (F.col("own_saved") + F.col("saved_tokens")).alias("saved_tokens"), F.explode(runs).alias("run"))
        path = paths.where((place > 0) & (place < half)).select("conv_id", F.shiftright(F.col("depth") - 1, RUN).alias("run"), "depth", "node", "parent")
        above = reach.join(path, ["conv_id", "run"]).where((F.col("depth") < F.col("cut")) & (F.col("depth") > F.col("cut") - half))
        above = above.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        added.append(saved(above, f"trie-above{k}"))
        added.append(grafts.where("n_leaves > 0 or saved_tokens > 0").select("node", F.lit(None).cast("binary").alias("parent"), "depth", "n_leaves", "saved_tokens"))
    return _all([held, *added]).groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of the conversations' turns (conv_id, at from 0 without gaps, token, words); `convs` (conv_id) are all conversations, turnless ones too.

    A node is a distinct sequence of first turns; its members are the conversations that start with
    it, its conv_id is the smallest of them. n_leaves counts childless nodes of its subtree and
    saved_tokens adds up (members - 1) times the words of the last turn over it. Without
    conversations the trie is empty; with turnless ones only it is the root.
    """
    paths, levels = name_prefixes(turns)
    least, members = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    nodes = saved(paths.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words")), "trie-named")
    even = nodes.where("depth % 2 = 0").drop("parent").withColumn("up", F.col("depth") - 1)
    even = even.join(paths.select("conv_id", F.col("depth").alias("up"), F.col("node").alias("parent")), ["conv_id", "up"]).drop("up")
    named = nodes.where("depth % 2 = 1").unionByName(even)

    root = turns.sparkSession.createDataFrame([(bytearray(ROOT), None, 0, least, members, 0)] if members else [], "node binary, parent binary, depth long, conv_id long, n_convs long, words long")
    marks = named.select(F.col("parent").alias("node"), F.lit(1).cast("long").alias("n_children"))
    rows = named.unionByName(root).withColumn("n_children", F.lit(0).cast("long")).unionByName(marks, allowMissingColumns=True)
    columns = ["parent", "depth", "conv_id", "n_convs", "words"]
    nodes = saved(rows.groupBy("node").agg(*[F.max(c).alias(c) for c in columns], F.sum("n_children").alias("n_children")), "trie-nodes")

    own = nodes.where("depth > 0").select("node", "parent", "depth", "conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = graft_totals(own, paths, levels)
    top = own.agg(F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1).cast("long")).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens")).select(F.lit(ROOT).alias("node"), "n_leaves", "saved_tokens")
    full = saved(nodes.join(totals.unionByName(top), "node").drop("words"), "trie-full")
    # the root's children know their parent without a join, in which they would be one key
    deep = full.where("depth > 1").join(full.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    shallow = full.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least)).cast("long"))
    return Trie(shallow.unionByName(deep), paths.select("conv_id", "depth", "node"))


def ends_hashes(paths: DataFrame, convs: DataFrame, *, part_bits: int = 13) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of the decimal ids of the conversations that end at each node, ascending and joined by commas, for nodes where some do.

    Ids are joined in parts of 2**part_bits consecutive ids. A SHA-256 is one running hash, so a
    node's parts pass through one task in order; they stream through it, and nothing is held but the
    hash's state.
    """
    ends = paths.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ends = convs.join(ends, "conv_id", "left").select("conv_id", F.coalesce("node", F.lit(ROOT)).alias("node"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy("node", F.shiftright("conv_id", part_bits).alias("part")).agg(ids.alias("ids"))

    def run_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return parts.repartition("node").sortWithinPartitions("node", "part").select("node", "ids").mapInArrow(run_on, "node binary, ends_sha256 string")


def conversation_trie(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[Trie, DataFrame]:
    """The trie of all rebuilt conversations, and the table (conv_id) of all conversations.

    Null roles and texts are empty; a null turn comes first; turns that tie are ordered by a hash of
    role and text; repeated rows are repeated turns. Rows without a conv_id belong to no conversation
    and take no part. An empty table gives an empty trie. Other columns are not read.
    """
    turns, convs = rebuilt(turns_of(conversations, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col))
    convs = saved(convs, "trie-convs")
    return prefix_trie(turns, convs), convs
