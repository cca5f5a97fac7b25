"""The corpus pipeline: toxic documents go, then exact copies, then near-duplicates, then repeated
passages; what is left is packed into sequences. Each stage takes (spark, docs, sf_dir), works on all
that its predecessor kept, and is written as Parquet before the next one reads it.

Documents keep their columns through all stages but the last, which gives the pieces of sequences."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm import digest_index, hyperminhash, packing, passages, toxicity
from veracity.llm.scratch import new_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (5): documents that score 0.5 or more go. The lexicon is learned from the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (2): one document of each normalised text stays."""
    return digest_index.without_copies(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (7): one document of each component stays; shingles of five words, 0.8."""
    return hyperminhash.keep_one(docs, hyperminhash.Settings(shingle=5))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup (6): words in repeated windows of 35 go; every document stays."""
    return passages.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (1): pieces of sequences of at most 4096 tokens."""
    return packing.pack(docs, os.environ.get("VERACITY_VOCABULARY") or default_vocabulary())


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("minhash near-dedup", unlike),
          ("substring dedup", without_repeats), ("packing", packed)]

# A learned lexicon, sketches and tokens are beyond SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = new_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
