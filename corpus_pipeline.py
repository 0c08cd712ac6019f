"""From raw documents to shards: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import jaccard, language, mixing, sharding, templates
from plumbline.llm.common import saved, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows of text in an Arrow batch: whole documents pass through Python, and a batch of Spark's own size holds tens of MB of them.
BATCH_ROWS = 1000


def in_small_batches(stage: Stage) -> Stage:
    """The stage in a session whose Arrow batches have at most BATCH_ROWS rows; the setting stays, as the stage's result is computed later."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        rows = int(spark.conf.get(key))
        spark.conf.set(key, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rank-order language profiles, learned from the documents' own languages; texts without a language go."""
    return language.accepted(docs, language.learn_profiles(docs))


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join, five words and a similarity of 0.8 or more; the smallest id of each group stays."""
    return jaccard.one_of_each(docs, shingle=5, percent=80)


@in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Template windows of the benchmark; documents that hold an item, even re-parameterised, go."""
    return templates.clean(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sainte-Lague apportionment to weights 3, 1, 2 over the sources and 150% of all words; documents repeat as the mix takes them."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, cap=2)


@in_small_batches
def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled splitters; returns (doc_id, size, text_crc32, shard, slot) of every row of the mix."""
    return sharding.shard_by_bytes(docs, shards=16)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", deal_shards),
]

#: The stages hash and learn in ways that SQL can't repeat; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
