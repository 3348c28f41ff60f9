"""What several operators of this subpackage share."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausetrail.plans.stages import stage
from clausetrail.session import ship_package

__all__ = ["crc32", "prepare", "read", "stage", "text_bytes"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Called before Python runs on executors."""
    ship_package(spark)


def text_bytes(text: Column | str) -> Column:
    """UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
