"""The corpus pipeline: documents of quality, without near copies and benchmark passages, mixed and sharded."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausetrail.llm import decontaminate, mixing, quality, sharding
from clausetrail.llm import near_copies as similar_texts
from clausetrail.llm.common import read
from clausetrail.llm.queries import folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that five-word shingle sets with a similarity of 0.8 or more link."""
    return similar_texts.drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and position of every document, from the written shards, with the documents.

    A column of the documents that has one of these names gives way.
    """
    path = folder(spark, "shards")
    sharding.write_shards(docs, path)
    others = [f"doc.`{c}`" for c in docs.columns if c.lower() not in ("shard", "slot")]
    return sharding.read_shards(spark, path, docs.schema).select(*others, "shard", "slot")


STAGES: list[tuple[str, Stage]] = [
    ("good quality", good_quality),
    ("near copies", near_copies),
    ("benchmark passages", benchmark_passages),
    ("source mix", source_mix),
    ("shards", shards),
]

# Fingerprints, trained scores and seeded choices have no counterpart in SQL; tests/llm has brute-force twins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each reads what the one before it has written."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = folder(spark, f"pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex[:8]}")
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
