"""One query per corpus operator: the operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm import (context_pii, dialog_repair, hyperminhash, order_minhash, packing, pfair_mix, quality_cascade, sentencepieces, suffix_dedup,
                           token_alignment, token_counts, warc_segments, zstd_secrets)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_pii.report(_table(spark, sf_dir, "documents"))


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.judge(_table(spark, sf_dir, "documents"))


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mixture of tempered source weights."""
    docs = _table(spark, sf_dir, "documents")
    short = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"))
    return pfair_mix.mix(short, pfair_mix.tempered(docs), order=["doc_id", "text_hash"]).drop("text_hash")


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op5_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.tokenize(_table(spark, sf_dir, "documents"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.report(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=200)


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_segments.round_trip(_table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_zstd_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstd_secrets.scan(_table(spark, sf_dir, "documents"))


def op11_dialog_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged, diagnosed and repaired."""
    return dialog_repair.report(dialog_repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=512)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_context_pii, op2_quality_cascade, op3_pfair_mix, op4_hyperminhash, op5_sentencepieces, op6_order_minhash, op7_suffix_dedup,
    op8_warc_segments, op9_best_fit_packing, op10_zstd_secrets, op11_dialog_repair, op12_token_counts, op13_token_alignment)}

# The others need iteration, hashing, schedules or compression that SQL lacks; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {
    "op2_quality_cascade": quality_cascade.ORACLE,
    "op4_hyperminhash": hyperminhash.ORACLE,
    "op8_warc_segments": warc_segments.ORACLE,
}
