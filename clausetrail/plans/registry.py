"""Named queries over the sample tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(build(spark, sf_dir))
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, so results compare across engines."""
    narrow = ("int", "smallint", "tinyint")
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in narrow else F.col(c) for c, t in df.dtypes])
