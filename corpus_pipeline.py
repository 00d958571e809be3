"""From raw documents to packed training sequences: five stages, each on what its predecessor kept.

An empty table stays empty through all of them, and further columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moderata.llm import decontaminate, minhash, packing, quality, suffix_dedup
from moderata.llm.shared import materialised


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them; the others stay as they are, repeated rows too."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the smallest id: five-word shingles, similarity 0.8.

    Documents without words or without an id stay; rows of one id stay or go together.
    """
    return minhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document of a smaller id also holds are cut out, in whole characters.

    Null texts stay null, a text may become empty; rows of one id, or without one, cut nothing from each other.
    """
    return suffix_dedup.remove_repeated_passages(docs, length=50)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in occurrences of ten-word benchmark windows are cut out; null texts stay null, an empty benchmark cuts nothing."""
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, laid into sequences of 2048; a null or empty text is its end token, repeated rows are packed each."""
    return packing.pack(docs, capacity=2048, end=0)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Min-max hashing, suffix orders and the tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialised(docs)
    return docs
