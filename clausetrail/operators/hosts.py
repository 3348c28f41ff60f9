"""Sites: the registrable domain of a host, and other facts per distinct host."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions import urls as U
from clausetrail.functions.idna import ascii_host
from clausetrail.sources import suffixes as SX

def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of fixed values, marked for broadcast: its size is that of the code."""
    names = [field.split()[0] for field in re.split(r",\s*(?![^<]*>)", schema)]
    return F.broadcast(spark.createDataFrame(pd.DataFrame(rows, columns=names), schema))


# Rules up to this size, in characters, are sent to all tasks; a larger list is joined as any table.
BROADCAST_CHARS = 4 << 20


def suffix_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(suffix, kind) rows; ``path`` names a list in the public suffix format ('*.x', '!y.x', '//' comments).

    Without a path it is the one of the setting, else the list that comes with the runtime.
    """
    path = path or SX.configured_path(spark)
    if path is None:
        rows = SX.default_rules()
        fits = sum(len(suffix) + len(kind) for suffix, kind in rows) <= BROADCAST_CHARS
        schema = "suffix string, kind string"
        return small_table(spark, rows, schema) if fits else spark.createDataFrame(rows, schema)
    line = F.lower(F.trim(F.split("value", r"\s")[0]))
    kind = F.when(F.startswith(line, F.lit("!")), "exception").when(F.startswith(line, F.lit("*.")), "wildcard").otherwise("exact")
    lines = spark.read.text(path).filter((line != "") & ~F.startswith(line, F.lit("//")))
    return lines.select(ascii_host(F.regexp_replace(line, r"^(!|\*\.)", "")).alias("suffix"), kind.alias("kind")).distinct()


def without_dots(host: Column) -> Column:
    """A host that is in ASCII already, in lower case and without dots at its ends."""
    return F.regexp_replace(F.lower(host), r"^\.+|\.+$", "")


def bare_host(host: Column) -> Column:
    """The host as sites and trackers are told by: ASCII, lower case, without dots at its ends."""
    return without_dots(ascii_host(host))


def host_dimension(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per distinct host: (host, registrable, tracker_domain, country).

    A host is judged by its bare form (``bare_host``); a host no rule knows is its own site.

    Suffix rules meet hosts by equality on each parent of the host, so no rule is compared with a
    host it cannot match.  Hosts are made distinct first: a host that fills a third of all requests
    is one row here.
    """
    distinct = hosts.select("host").filter(F.col("host") != "").distinct()
    distinct = distinct.withColumn("bare", bare_host(F.col("host")))
    parents = distinct.select("host", "bare", F.posexplode(U.host_suffixes(F.col("bare"))).alias("pos", "suffix"))
    size = F.size(F.split("suffix", r"\."))

    def longest(kind: str, value: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col("kind") == kind, value)), F.lit(0))

    matched = parents.join(rules, "suffix", "left")
    depth = matched.groupBy("host", "bare").agg(
        longest("exact", size).alias("exact"),
        longest("wildcard", F.when(F.col("pos") > 0, size + 1)).alias("wildcard"),
        longest("exception", size).alias("exception"),
        F.bool_or(F.col("suffix").isin(R.TRACKER_DOMAINS)).alias("tracker_domain"),
    )
    labels = F.split("bare", r"\.")
    public = F.when(F.col("exception") > 0, F.col("exception") - 1).otherwise(F.greatest("exact", "wildcard"))
    unsplit = (F.size(labels) <= 1) | U.is_ipv4(F.col("bare")) | F.contains("bare", F.lit(":"))
    own = F.array_join(F.slice(labels, F.size(labels) - public, public + 1), ".")
    registrable = F.when(unsplit | (public == 0) | (F.size(labels) <= public), F.col("bare")).otherwise(own)
    return depth.select("host", registrable.alias("registrable"), "tracker_domain", U.country_of(F.col("bare")).alias("country"))


def with_host_facts(df: DataFrame, facts: DataFrame, host: str = "host", prefix: str = "") -> DataFrame:
    """Join host facts; hot hosts are handled by the adaptive skew join, small facts by broadcast."""
    renamed = facts.select(
        F.col("host").alias(host), *[F.col(c).alias(f"{prefix}{c}") for c in facts.columns if c != "host"]
    )
    return df.join(renamed, host, "left")
