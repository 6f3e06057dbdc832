"""Corpus preparation: five stages, each written as Parquet and read again by the next.

Every stage takes any documents table with the columns of ``documents``, extra ones included, and bears nulls in all of
them, empty and very long texts, repeated rows and empty tables as its operator says. Documents without an id are never
taken for duplicates of each other but by content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, mixing, near_dedup, oracle, quality_rules, sharding
from lodestone.llm.scratch import new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that are frequent in their host. Null and empty texts fail; rows that repeat a text share its verdict."""
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the smallest id; rows that repeat that id, and rows without an id, stay."""
    return near_dedup.drop_near_duplicates(docs, NEAR_PERCENT)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate. Null texts stay; an empty benchmark contaminates nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights take them, twice at most. Texts without words aren't taken; a null source is a source."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, and their slot in it; rows alike in all are placed side by side in any order."""
    placed = sharding.assign(docs)
    return placed.select(*[c for c in docs.columns if c not in ("shard", "slot")], placed["shard_"].alias("shard"), placed["slot_"].alias("slot"))


#: Near copies of the pipeline share this part of their shingles or more; op1_near_dedup has its own threshold.
NEAR_PERCENT = 80

STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("decontaminate", clean), ("mix_sources", mix), ("shards", shard)]

#: The five stages behind each other, for documents with ids of their own.
ORACLE_SQL = oracle.pipeline(NEAR_PERCENT)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
