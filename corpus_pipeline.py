"""The training-data pipeline: from raw documents to token ids, stage by stage.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. run() applies them to the
documents table and writes each stage's result as Parquet to the shared folder, from which the next one reads.

Edge cases: a null or empty text has no words and goes in the first stage, as does any text of under 20 words; a text without
a letter, or one that the network isn't sure of, goes in the second, as do all texts if no document has a language; null ids,
sources and languages are values of their own; rows are told apart by id and text, and of rows that are equal in both one
stays in the third stage; a long text is read whole by every stage; an empty table, or one of which nothing is kept, gives
an empty result with the last stage's columns; further columns are carried to the fourth stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm import bpe, jaccard, langid, mixing, quality
from fieldspark.llm.common import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule, every document rule and their host's verdict."""
    return quality.reject_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows."""
    return langid.reject_unknown(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each component of near copies."""
    return jaccard.keep_one(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing_sources),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: SQL can't express the trained network, the merges or the hashes of ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of `sf_dir`."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if i < len(STAGES) - 1:
            df = materialise(df, f"stage{i}")
    return df
