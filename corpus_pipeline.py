"""Corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing of sources, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Stages write Parquet to the
folder the session shares and the next one reads it. Null, empty and very long texts, repeated rows and empty tables
follow the operators' docstrings: an undetermined language is rejected at once, so texts without a letter leave there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import bpe, common, exact_dedup, language_id, mixing, near_dedup


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told."""
    return language_id.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 stays."""
    return near_dedup.without_near_copies(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, sorted over the written files into the mixture's order."""
    return mixing.in_mixed_order(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """mix_place (the rows' order in the mixture), token counts, digests of ids and decoded texts."""
    return bpe.round_trip(docs.withColumn("mix_place", mixing.written_place()), bpe.default_path(), "mix_place")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", encode_bpe),
]

#: Cross-parsing, near duplicates and BPE are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
