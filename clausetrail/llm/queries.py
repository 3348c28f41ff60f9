"""The named queries of these operators, with production parameters, and their check statements."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausetrail.llm import (
    chat,
    conversation_repair,
    decontaminate,
    mixing,
    quality,
    secrets,
    sharding,
    simhash,
    spelling,
    substrings,
    suffix_repeats,
    token_files,
    topk,
)
from clausetrail.llm.common import read
from clausetrail.llm.statements import STATEMENTS
from clausetrail.plans.stages import stage_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one all executors share."""
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_source_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    chosen = mixing.choose(mixing.sized_documents(read(spark, sf_dir, "documents")))
    return chosen.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken")
    )


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets, counts and checksums read back from the ORC token files of all documents."""
    path = folder(spark, "tokens")
    token_files.write_tokens(read(spark, sf_dir, "documents"), path, tokenizer_file())
    return token_files.token_digests(spark, path)


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op4_top_products")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector with all others."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), "pmod(vec_id, 50) = 0")


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op6_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


@query("op7_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the written shards."""
    path = folder(spark, "shards")
    docs = read(spark, sf_dir, "documents")
    sharding.write_shards(docs, path)
    return sharding.placements(sharding.read_shards(spark, path, docs.schema))


@query("op8_chat")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted turns."""
    columns = ["conv_id", "turn", "role", "text"]
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    rows = read(spark, sf_dir, "conversations").select(*columns).unionByName(extra)
    path = folder(spark, "chat")
    chat.write_turns(chat.linear_tree(rows), path, distinct_nodes=True)
    return chat.digests(chat.read_turns(spark, path)).drop("branch")


@query("op10_near_copies")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.documents_with_groups(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast("bigint").alias("component_id")
    )


ORACLE_SQL: dict[str, str] = dict(STATEMENTS)


@query("op9_repeated_passages")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of every document, from content-defined chunks."""
    return substrings.repeats(read(spark, sf_dir, "documents"))


@query("op11_maximal_repeats")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without the 50-byte strings that a document with a smaller id holds."""
    return suffix_repeats.removals(read(spark, sf_dir, "documents"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after seeded damage."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.reports(conversation_repair.damage(rows), rows.select("conv_id"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.misspelt(read(spark, sf_dir, "documents"))
