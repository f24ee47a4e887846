"""The training-data pipeline over ``documents``; each stage is written as Parquet and read again by the next.

All stages but the last return the columns of ``documents``; the last adds shard and slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontaminate, language, mixing, ngram_join, sharding
from tickloom.session import checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the labelled rows; rows without letters or in no language go."""
    model = language.fit_languages(docs.where(~language.held_out("doc_id", 5, 0)))
    return language.keep_identified(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id."""
    return ngram_join.keep_one_per_component(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target shares of the tokens."""
    return mixing.draw_mixture(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard, and its place in it."""
    return sharding.shard_records(docs).drop("_h", "_d", "_size", "_crc")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", near_duplicates),
    ("template_decontamination", decontaminated),
    ("mixing_to_targets", mixed),
    ("sharding", sharded),
]
ORACLE_SQL = None  # naive Bayes, trie joins and raking have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
