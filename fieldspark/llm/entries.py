"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, divergence, fingerprint, html, jaccard, langid, lm, mixing, orcids, quality, sharding, sql, whitening
from .common import materialise


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.document_features(_docs(spark, sf_dir).select("doc_id", "source", "text")).drop("text")
    judged = quality.judge(materialise(measured, "features"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _docs(spark, sf_dir).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    sizes = materialise(sizes, "sizes")
    return mixing.mix(sizes, mixing.mix_plan(sizes)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(_docs(spark, sf_dir))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_docs(spark, sf_dir))


def op3_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(_docs(spark, sf_dir))


def op4_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_docs(spark, sf_dir))


def op6_token_group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_docs(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orcids.round_trip(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_count_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_docs(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")


ALL = (op1_host_rules, op2_context_tree, op3_byte_gru, op4_wrapper_induction, op5_hilbert_shards, op6_token_group_matrix, op7_byte_bpe, op8_orc_ids, op9_pareto_mix, op10_bottom_k, op11_count_bitmaps, op12_whitening, op13_decontamination)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ALL}

SQL: dict[str, str] = {"op1_host_rules": sql.OP1, "op6_token_group_matrix": sql.OP6, "op9_pareto_mix": sql.OP9, "op11_count_bitmaps": sql.OP11, "op13_decontamination": sql.OP13}
