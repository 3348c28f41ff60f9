"""Captured requests reduced to facts without values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausetrail.functions import urls as U
from clausetrail.functions.patterns import let


def minimise(requests: DataFrame, max_url_chars: int | None = None) -> DataFrame:
    """Keeps scheme, host, shortened path and masked query keys; drops logins, values and fragments.

    Rows whose URL is not http(s) are dropped.  ``max_url_chars`` also drops longer URLs.
    """

    def kept(p):
        path = U.minimal_path(p["path"])
        return F.struct(
            p["host"].alias("host"),
            path.alias("path"),
            p["scheme"].alias("scheme"),
            U.authority(p).alias("authority"),
            U.field_keys(F.transform(U.query_pairs(p["query"]), lambda q: q["key"])).alias("query_keys"),
        )

    facts = let(U.parts(F.col("url")), lambda p: F.when(p.isNotNull(), kept(p)))
    if max_url_chars:
        facts = F.when(F.length("url") <= max_url_chars, facts)
    narrow = requests.select(
        "request_id", "tab_id", "ts", F.upper(F.substring("method", 1, 16)).alias("method"), "resource_type", F.inline_outer(F.array(facts))
    ).filter(F.col("host").isNotNull())
    return narrow.select(
        "request_id",
        "tab_id",
        "ts",
        F.concat("scheme", F.lit("://"), "authority", "path").alias("url"),
        "host",
        "path",
        "scheme",
        "method",
        "resource_type",
        "query_keys",
    )


def exclude_origins(events: DataFrame, origins: DataFrame, origin: str = "origin", enabled: bool = True) -> DataFrame:
    """Drops events of excluded exact origins; a global pause drops everything."""
    if not enabled:
        return events.filter(F.lit(False))
    excluded = origins.select(F.col("origin").alias(origin)).distinct()
    return events.join(excluded, origin, "left_anti")


def clean_origins(origins: DataFrame) -> DataFrame:
    """Origins a user listed, as exact origins; unusable lines are dropped."""
    text = F.trim("origin")
    url = F.when(text.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), text).otherwise(F.concat(F.lit("https://"), text))
    cleaned = origins.select(let(U.parts(url), lambda p: F.when(p.isNotNull(), U.origin(p))).alias("origin"))
    return cleaned.filter(F.col("origin").isNotNull()).distinct()
