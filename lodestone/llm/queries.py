"""Registered queries of this subpackage: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, licenses, manifest, mixing, near_dedup, personal_data, prefix_trie, quality_model, quality_rules, secrets, sharding, substring_dedup, topk
from lodestone.llm.oracle import ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: one row for each, with its set size, the smallest id it is linked with, and whether that is its own."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of all documents, by a model fitted on the rated ones among them."""
    docs = _table(spark, sf_dir, "documents")
    return quality_model.scored(docs, quality_model.trained(docs, _table(spark, sf_dir, "labels")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, from a ledger that the query begins anew, so that every blob is scanned once."""
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op4_consistent_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards whose counts differ by one at most."""
    rows = sharding.assign(_table(spark, sf_dir, "documents"), columns=["doc_id"])
    return rows.select("doc_id", F.col("size_").alias("size"), F.col("crc_").alias("text_crc32"), F.lit(sharding.LAW).alias("law"), F.col("shard_").alias("shard"), F.col("slot_").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in windows of benchmark items."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and edited notices of all documents."""
    return license_columns(licenses.license_spans(_table(spark, sf_dir, "documents")))


def license_columns(found: DataFrame) -> DataFrame:
    """The columns of the contract, and the edits of the notice that stands with fewest."""
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.array_min(F.transform("spans", lambda x: x["edits"])).alias("least_edits"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and verdicts of all documents."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"]
    return quality_rules.judged(_table(spark, sf_dir, "documents")).select(*columns)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeat earlier ones, and a digest of what stays."""
    return substring_dedup.deduplicated(_table(spark, sf_dir, "documents"), keep=False)


def op9_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents, and the terms that give any of it away."""
    return personal_data.digest(personal_data.private_spans(_table(spark, sf_dir, "documents")))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each of all documents."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every hundredth vector, against all vectors."""
    return topk.nearest(_table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, proof and verification of all documents; some are tampered with before they are verified."""
    return manifest.audited(manifest.document_manifest(_table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_quality_model, op3_secret_scan, op4_consistent_hash_shards, op5_decontaminate, op6_license_notices, op7_quality_rules, op8_suffix_dedup, op9_private_terms, op10_mix_sources, op11_top_k, op12_merkle_manifest, op13_prefix_trie)}

__all__ = ["ORACLE_SQL", "QUERIES"]
