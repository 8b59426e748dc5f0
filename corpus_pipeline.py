"""The training-corpus pipeline: language, toxicity, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. What it decides takes effect: texts without a language or with an
ambiguous one go, toxic ones go, of each group of near-duplicates one stays,
texts in which two benchmark items occur go and single leaked passages are cut
out, and what is left is encoded. Models learn outside the held-out folds.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import bpe_monoid, language_id, simhash, toxicity, winnowing
from seqloom.llm.batches import table
from seqloom.llm.durable import checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accept(docs, language_id.learn(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accept(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnowing.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_monoid.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: Trained models and XXH64 with a seed have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    place = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{place}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
