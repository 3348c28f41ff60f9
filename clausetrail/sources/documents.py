"""Reading inputs and deciding which captured documents are admitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions import urls as U


def read_table(spark: SparkSession, path: str, schema: str | None = None, format: str = "parquet") -> DataFrame:
    """A batch table with an explicit schema.  ``spark.sql.files.maxPartitionBytes`` sets how it is split."""
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema else reader).load(path)


def read_stream(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    return spark.readStream.format(format).schema(schema).load(path)


# -- admission --------------------------------------------------------------------------


def url_category(url: Column) -> Column:
    """First reason to refuse a policy URL, NULL when it is acceptable."""
    p = U.parts(url)
    return (
        F.when(url.isNull() | (F.length(url) > R.MAX_POLICY_URL_CHARS), "invalid_url")
        .when(p.isNull() & url.rlike(r"^(?i)[a-z][a-z0-9+.-]*:") & ~url.rlike(r"(?i)^https?:"), "scheme")
        .when(p.isNull(), "invalid_url")
        .when(p["login"] != "", "credentials")
        .when(U.private_host(p["host"]), "private_host")
        .when(p["scheme"] != "https", "not_https")
        .when(U.sensitive_query(p["query"]), "secret_query")
    )


def mime_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))


def admission(url: Column, content_type: Column, body: Column) -> Column:
    """'admitted' or the first reason to refuse the document."""
    return F.coalesce(
        url_category(url),
        F.when(~mime_type(content_type).isin(R.POLICY_CONTENT_TYPES), "content_type"),
        F.when(F.octet_length(body) > R.MAX_POLICY_BYTES, "response_too_large"),
        F.lit("admitted"),
    )


def admit(fetches: DataFrame) -> DataFrame:
    """Adds ``category``; keep the rows where it is 'admitted'."""
    return fetches.withColumn("category", admission(F.col("url"), F.col("content_type"), F.col("body")))


def admission_funnel(fetches: DataFrame) -> DataFrame:
    return admit(fetches).groupBy("category").agg(F.count("*").alias("documents"))


# Order matters: the first part found names the category.
ERROR_WORDS = [
    ("timeout", ["timed out"]),
    ("redirect", ["redirect"]),
    ("content_type", ["content type"]),
    ("response_too_large", ["size limit", "too large"]),
    (
        "invalid_url",
        [
            "invalid policy url",
            "policy url scheme",
            "https policy",
            "private policy host",
            "policy url credentials",
            "sensitive policy url",
        ],
    ),
]


def error_category(message: Column) -> Column:
    """Category of a failed check from its message."""
    text = F.lower(F.coalesce(message, F.lit("")))
    chain = F.when(text.rlike(r"policy fetch failed:\s*\d{3}"), "http_status").when(
        F.contains(text, F.lit("fetch")) | F.contains(text, F.lit("network")), "network"
    ).otherwise("unknown")
    for category, words in reversed(ERROR_WORDS):
        test = F.lit(False)
        for word in words:
            test = test | F.contains(text, F.lit(word))
        chain = F.when(test, category).otherwise(chain)
    return chain
