"""Queries on policy versions and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausetrail.functions import findings as FN
from clausetrail.operators import versions as V
from clausetrail.plans.inputs import inputs
from clausetrail.plans.registry import query

NOW = "2024-01-30 18:00:00"


@query("ver_1_version_rows")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).versions.select(
        "url_key",
        "version",
        "text_length",
        "truncated",
        F.size(F.filter("sections", lambda s: s["found"])).alias("sections"),
        F.array_join("risk_ids", "|").alias("risk_ids"),
        "level",
        "score",
    )


@query("ver_2_text_hashes")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).versions.select("url_key", "version", "text_hash")


@query("ver_3_section_changes")
def _(spark, sf_dir):
    rows = inputs(spark, sf_dir).comparisons.select("url_key", "version", F.inline("section_changes"))
    return rows.select("url_key", "version", F.col("id").alias("section_id"), "change_type")


@query("ver_4_risk_changes")
def _(spark, sf_dir):
    rows = inputs(spark, sf_dir).comparisons
    return rows.select("url_key", "version", *[F.array_join(F.array_sort(c), "|").alias(c) for c in ("added_risks", "removed_risks")])


@query("ver_5_change_verdicts")
def _(spark, sf_dir):
    rows = inputs(spark, sf_dir).comparisons
    return rows.select("url_key", "version", "previous_at", "changed", FN.id_severities(F.col("findings")).alias("findings"))


@query("ver_6_high_impact_changes")
def _(spark, sf_dir):
    rows = inputs(spark, sf_dir).comparisons.select("url_key", "version", F.explode("section_changes").alias("c"))
    return rows.filter(V.high_impact(F.col("c"))).select("url_key", "version", F.col("c.id").alias("section_id"))


@query("ver_7_changes_worth_telling")
def _(spark, sf_dir):
    return V.worth_telling(inputs(spark, sf_dir).comparisons).select("url_key", "version")


@query("ver_8_unsent_changes")
def _(spark, sf_dir):
    """Second versions were announced already; their keys must not be sent again."""
    told = V.with_dedupe_key(V.worth_telling(inputs(spark, sf_dir).comparisons))
    sent = told.filter(F.col("version") == 1)
    return V.not_yet_sent(told, sent).select("url_key", "version", "dedupe_key")


@query("ver_9_current_baselines_only")
def _(spark, sf_dir):
    x = inputs(spark, sf_dir)
    live = V.upsert(x.versions.filter(F.col("version") == 0), x.versions.filter(F.col("version") == 1))
    return V.still_current(V.worth_telling(x.comparisons), live).select("url_key", "version")


@query("ver_10_due_checks")
def _(spark, sf_dir):
    x = inputs(spark, sf_dir)
    return V.due(x.newest_versions, x.health, F.lit(NOW).cast("timestamp")).select("url_key", "captured_at", "last_attempt_at")


@query("ver_11_check_health")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).health


@query("ver_12_pruned_versions")
def _(spark, sf_dir):
    captures = inputs(spark, sf_dir).view("fx_policy_versions")
    items = captures.select(
        F.concat(F.lit("tenant-"), F.regexp_extract("url_key", r"site(\d)", 1)).alias("tenant"),
        F.concat_ws("#", "url_key", "version").alias("url_key"),
        "captured_at",
        F.octet_length("body").cast("bigint").alias("bytes"),
    )
    return V.prune(items, 50, 12_000)


@query("ver_13_run_summary")
def _(spark, sf_dir):
    rows = inputs(spark, sf_dir).comparisons
    return V.run_summary(rows, V.worth_telling(rows))


@query("ver_14_notifications")
def _(spark, sf_dir):
    return V.notifications(V.worth_telling(inputs(spark, sf_dir).comparisons))


@query("snk_2_version_upsert")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).newest_versions.select("url_key", "version", "captured_at", "text_hash")
