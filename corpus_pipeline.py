"""From raw documents to sharded training data, in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before kept. All
but the last return the columns of ``documents``; what a stage decides has taken effect in
the rows it returns: toxic documents are gone, one document is left of each group of near
duplicates, benchmark windows are cut out of the texts, sources are replicated to their
target weights, and the last stage adds each row's shard and slot.

The first stage scores with a learnt model, which SQL cannot express; ``tests/llm`` holds
the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import decontaminate, mixing, parity_join, ring_shards, toxicity
from loomspark.llm.queries import DEFAULT_WEIGHT, LABELLED_ROWS, SHARDS, VNODES, WEIGHTS, WINDOW
from loomspark.llm.tables import small_batches, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), LABELLED_ROWS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more."""
    small_batches(spark)
    return parity_join.keep_one(docs, size=5, percent=80)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.cut_leaks(docs, table(spark, sf_dir, "benchmark"), WINDOW)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, WEIGHTS, DEFAULT_WEIGHT).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ring_shards.assign_shards(docs, SHARDS, VNODES, keep=("text", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
