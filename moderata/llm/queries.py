"""The queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderata.llm import oracles

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moderata.llm.suffix_dedup import repeated_passages

    found = repeated_passages(_table(spark, sf_dir, "documents"), length=50)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moderata.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moderata.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moderata.llm.decontaminate import find_contamination

    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moderata.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moderata.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), capacity=2048, end=0)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moderata.llm.urls import Rule, filter_urls

    rules = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]
    return filter_urls(_table(spark, sf_dir, "pages"), rules)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moderata.llm.chat import digests, format_windows

    said = r"\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("int"), "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    return digests(format_windows(rows.unionByName(planted)))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moderata.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moderata.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moderata.llm.turn_repair import damaged, digests, repair

    rows = _table(spark, sf_dir, "conversations")
    audits, turns = repair(damaged(rows))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    known = rows.select(F.col("conv_id").cast("bigint").alias("known_id")).distinct()
    sums = digests(turns).withColumnRenamed("conv_id", "sum_id")
    told = known.join(audits, F.col("known_id").eqNullSafe(F.col("conv_id")), "left").join(sums, F.col("known_id").eqNullSafe(F.col("sum_id")), "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return told.select(F.col("known_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moderata.llm.sketches import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moderata.llm.periodic import digests, periodic_runs, with_repeats

    return digests(periodic_runs(with_repeats(_table(spark, sf_dir, "documents")), least=12))


QUERIES: dict[str, Query] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_token_counts": op3_token_counts,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_url_filters": op7_url_filters,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_rules": op10_quality_rules,
    "op11_turn_repair": op11_turn_repair,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = oracles.SQL
