"""From documents to token ids: quality, exact copies, near copies, benchmark passages, SentencePiece.

Each stage works on all rows that the one before it kept; what it drops is gone. All but the last return the columns of
documents. Stages are written as Parquet in the shared folder and read again, so a lost executor costs one stage's work
at most; what a stage stored on its way is dropped once its result stands, and so is the result before it.

Defined results: null, empty and blank texts, having no perplexity, go in the first stage. A null doc_id is kept like
any other and loses ties. Rows that repeat are copies: the second stage keeps one. Very long texts are read whole in
every stage. An empty table gives an empty result, with the last stage's columns. Columns that documents have besides
its own are carried along up to the last stage, whatever they are called, and end there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkreel.llm import decontam, exact_dedup, quality, simhash, sp_codec
from sparkreel.llm.common import remove, scratch, shared_dir, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return simhash.near_dedup(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, plain or with other numbers and names."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether they decode to it again."""
    return sp_codec.encode(docs.select("doc_id", "lang", "source", "text"), to="token_ids", round_trip="round_trip")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("sentencepiece_codec", token_ids),
]

#: SQL can express neither the language model nor the fingerprints; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return docs
