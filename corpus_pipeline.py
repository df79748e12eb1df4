"""A corpus pipeline: from raw documents to mixed, tokenised training text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents, save the last, which returns
what the tokenizer made of each text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftlake.llm import mixing, near_dedup, quality_rules, sentencepiece_bpe, substring_dedup
from driftlake.llm.queries import MODEL
from driftlake.llm.tables import new_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    return near_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that start elsewhere too."""
    return substring_dedup.strip(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix draws them: some sources' several times, others' in part, each source up to its target."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every drawn text."""
    return sentencepiece_bpe.encode_decode(docs, public_tokenizers.path(MODEL), others=["source", "lang"])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("tokens", tokens)]

ORACLE_SQL = None  # SQL can't express the tokenizer; tests compare every stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:  # the next stage reads its input more than once
            path = new_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
