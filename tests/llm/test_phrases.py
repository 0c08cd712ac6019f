"""Collocations against counts of all phrases: nulls, blanks, ties, repeats, hot words whose stripes are divided, small flushes, empty tables, clashing columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import phrases

from . import brute

SCHEMA = "doc_id long, text string, lang string"


def texts():
    rng = random.Random(11)
    vocabulary = ["the", "of", "Élan", "é", "x" * 300, "IS", "a-b", " ", "new", "york"] + [f"w{i}" for i in range(40)]
    out = [(1, None, "en"), (2, "", "en"), (3, " \t ", None), (4, "...,,;;", "en"), (None, "new york, new york", None), (5, "new york\rnew york\x0bcity", "en"), (5, "new york\rnew york\x0bcity", "en"), (6, "straße der der der", "de")]
    for i in range(150):
        w = [rng.choice(vocabulary[:6]) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            w[len(w) // 2 : len(w) // 2] = ["New", "York", "is", "the", "place", "of", "all"][: rng.randrange(2, 8)]
        out.append((10 + i, "".join(x + rng.choice([" ", "  ", "\t", " ", " ", ", ", ".\n"]) for x in w), rng.choice(["en", "de", None])))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).select("*", *[F.lit("clash").alias(c) for c in ("node", "n", "phrase", "prefix", "rank", "slice", "word")]).repartition(5)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least, top", [(3, 2000), (2, 7), (10, 50)])
def test_collocations_equal_plain_counts(docs, least, top):
    assert rows(phrases.collocations(docs, least=least, top=top)) == sorted(brute.collocations([(t, lang) for _, t, lang in texts()], least, top))


def test_divided_stripes_and_many_rows_of_a_stripe(docs, spark, monkeypatch):
    """Slices from two occurrences up, three entries a row, Arrow batches of two rows: the same result."""
    monkeypatch.setattr(phrases, "_SLICED", 1)
    monkeypatch.setattr(phrases, "_ROW", 3)
    monkeypatch.setattr(phrases, "_HELD", 200)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        assert rows(phrases.collocations(docs, least=3)) == sorted(brute.collocations([(t, lang) for _, t, lang in texts()], 3, 2000))
    finally:
        spark.conf.set(key, before)


def test_stripe_totals_are_the_prefix_counts(docs):
    own = phrases._texts(docs, "text", "lang")
    words = phrases.word_counts(own)
    striped = phrases.stripes(own, words.where("n >= 2"), 1, 2)
    totals = {r["prefix"]: r["n"] for r in striped.groupBy("prefix").agg(F.sum("total").alias("n")).collect()}
    counts = {r["node"]: r["n"] for r in words.where("n >= 2").collect()}
    assert {k: totals[k] for k in counts} == counts


def test_no_rows_and_no_frequent_phrase(spark, docs):
    assert rows(phrases.collocations(spark.createDataFrame([], SCHEMA))) == []
    assert rows(phrases.collocations(docs, least=10**9)) == []
    assert rows(phrases.collocations(spark.createDataFrame([(1, "a b. c d", "en")] * 3, SCHEMA), least=3)) == [("en", 1, "a b", 3, 3, 3, 12, 4000), ("en", 2, "c d", 3, 3, 3, 12, 4000)]


def test_large_counts_stay_exact(spark):
    a, n = 5 * 10**14, 9 * 10**16
    df = spark.createDataFrame([([10**15 + 7, 7], [3 * 10**15, 11], a, n)], "lefts array<long>, rights array<long>, a long, n long")
    got = df.select(phrases.lowest_cut(F.col("n")).alias("c")).first()["c"]
    want = min((1000 * a * n // (left * right), k, left, right) for k, (left, right) in enumerate([(10**15 + 7, 3 * 10**15), (7, 11)], 1))
    assert tuple(got) == want
