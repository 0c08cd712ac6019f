"""The conversation trie against a plain one: nulls, ties, repeated rows, turnless and very long conversations, copies, empty tables, clashing columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import trie

from . import brute

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def found(df, **options):
    tree, convs = trie.conversation_trie(df)
    nodes = tree.nodes.join(trie.ends_hashes(tree.paths, convs, **options), "node", "left")
    return [tuple(r) for r in nodes.select(*COLUMNS, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).collect()]


def odd_rows():
    rng = random.Random(5)
    rows = [
        (None, 0, "user", "no conversation"), (1, None, "user", "null turn first"), (1, 0, None, "null role"), (1, 1, "user", None), (2, 0, "user", ""), (2, 0, "user", ""), (2, 0, "bot", "tie"),
        (7, 0, "user", "x"), (-3, 0, "user", "negative"), (-20, 0, "user", "negative base"), (41, 0, "u", "only"), (61, 0, "u", "only"), (5, 3, "a", " \t\n "), (5, 1, "a", "é b c"),
    ]
    for c in range(100, 160):  # copies and common beginnings of several lengths
        kind = rng.randrange(4)
        rows += [(c, t, "user" if t % 2 == 0 else "bot", f"line {kind} {t // (3 + kind)}") for t in range(rng.randrange(0, 12))]
    rows += [(200, t, "user", f"word {t % 3} and more") for t in range(170)] + [(210, t, "user", f"word {t % 3} and more") for t in range(133)] + [(211, t, "user", f"word {t % 3} and more" if t < 90 else "else") for t in range(140)]
    return rows


@pytest.mark.parametrize("part_bits", [13, 1])
def test_trie_equals_a_plain_one(spark, part_bits):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in ("node", "at", "token", "words", "depth", "parent", "run", "base")])
    assert sorted(found(df, part_bits=part_bits), key=repr) == sorted(brute.conversation_nodes(rows), key=repr)


def test_few_and_no_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    for rows in ([(None, 0, "u", "t")], [(3, 0, "u", "one two")], [(c, 0, "u", "one two") for c in (61, 41, 21)]):
        assert sorted(found(spark.createDataFrame(rows, SCHEMA)), key=repr) == sorted(brute.conversation_nodes(rows), key=repr)


def test_rows_of_one_conversation_lie_in_several_ranges(spark):
    """One conversation holds nearly all rows, half of them alike: its places are gapless and its tied rows don't land in one range."""
    df = spark.range(4000).select(F.lit(20).cast("long").alias("conv_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("turn"), F.lit("u").alias("role"), F.lit("same").alias("text"))
    placed = trie.numbered(trie.turns_of(df))
    assert [r["at"] for r in placed.orderBy("at").select("at").collect()] == list(range(4000))
    assert [r["turn"] for r in placed.orderBy("at").select("turn").collect()] == [None] * 2000 + list(range(0, 4000, 2))
    assert placed.withColumn("p", F.input_file_name()).groupBy("p").count().count() > 1
