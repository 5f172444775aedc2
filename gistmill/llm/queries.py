"""The registered query of each operator: production parameters, whole tables, whole results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, fingerprints, jaccard, pii, quality, scoring, sharding, sql, substrings, toxicity
from .common import text_bytes

#: The rank file of byte-level BPE and its splitting pattern.
VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op2_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return jaccard.link(table(spark, sf_dir, "documents"))


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of nearly equal bytes."""
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", F.crc32(text_bytes()).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text decoded from them, as digests."""
    return bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN, digests=True)


def op6_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.fit(docs, labels, "toxic"))
    return _judged(found, 0.5)


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every text."""
    return scoring.score(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or an edited copy of one; only those have rows."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the passages that an earlier document has."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.score(docs, quality.fit(docs, labels, "quality"))
    return _judged(found, 0.3)


def _judged(found: DataFrame, least: float) -> DataFrame:
    held_out = quality.bucket_of(F.col("doc_id"), 5) == 0
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def queries() -> dict:
    return {
        "op1_pii_anchors": op1_pii_anchors,
        "op2_parity_jaccard": op2_parity_jaccard,
        "op3_histogram_shards": op3_histogram_shards,
        "op4_prefix_fingerprints": op4_prefix_fingerprints,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_toxicity_ftrl": op6_toxicity_ftrl,
        "op7_context_tree": op7_context_tree,
        "op8_decontamination": op8_decontamination,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_quality_trees": op10_quality_trees,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the two operators that it can express; tests hold the others against plain versions."""
    return {"op2_parity_jaccard": sql.PARITY_JACCARD, "op9_substring_dedup": sql.SUBSTRING_DEDUP}
