"""The corpus operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftlake.llm import html_extract, imatch, lm_score, merkle, mixing, near_dedup, periodic, quality_rules, sentencepiece_bpe, sharding, substring_dedup, token_files, warc
from driftlake.llm.tables import table

MODEL = "piece_bpe_32k.model"  # of the public vocabulary files
TOKENIZER = "word_bpe_49k.json"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), model_file or public_tokenizers.path(MODEL))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which rule rejected first depends on measured costs, so that column stays with the operator
    return quality_rules.assess(table(spark, sf_dir, "documents")).drop("rejected_by", "n_lines")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("target_uri", "payload")


def op11_token_files(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_file or public_tokenizers.path(TOKENIZER)).drop("ids")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.runs(table(spark, sf_dir, "documents")).drop("runs", "collapsed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_lm_score": op3_lm_score,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_imatch": op6_imatch,
    "op7_mix_sources": op7_mix_sources,
    "op8_hilbert_shards": op8_hilbert_shards,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "op11_token_files": op11_token_files,
    "op12_merkle": op12_merkle,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE: dict[str, str] = {
    "op12_merkle": merkle.QUERY_SQL,
    "op7_mix_sources": mixing.QUERY_SQL,
    "op9_quality_rules": quality_rules.QUERY_SQL,
}
