"""Does the policy cover what the page was seen to do?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausetrail.functions import findings as FN
from clausetrail.operators import sections as S


def observed_signals(
    network: DataFrame, forms: DataFrame, storage: DataFrame, consent: DataFrame, overseas: DataFrame
) -> DataFrame:
    """One row of booleans per tab seen by any analysis."""
    parts = [
        network.select("tab_id", F.size("third_party_hosts").alias("third"), F.size("tracker_hosts").alias("trackers")),
        forms.select("tab_id", "sensitive_count", F.transform("categories", lambda c: c["category"]).alias("form_categories")),
        storage.select(
            "tab_id",
            "third_party_cookies",
            (F.col("local_keys") + F.col("session_keys") + F.col("cookie_count")).alias("stored"),
            F.transform("classified", lambda c: c["category"]).alias("storage_categories"),
        ),
        consent.select("tab_id", "requests_observed", "cookies_observed"),
        overseas.select("tab_id", "overseas_status"),
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, "tab_id", "full")

    def positive(name: str) -> Column:
        return F.coalesce(F.col(name) > 0, F.lit(False))

    none = F.array().cast("array<string>")
    sensitive = F.concat(F.coalesce("form_categories", none), F.coalesce("storage_categories", none))
    return joined.select(
        "tab_id",
        (positive("third") | positive("third_party_cookies")).alias("has_third_party"),
        (positive("trackers") | positive("requests_observed") | positive("cookies_observed")).alias("has_tracking"),
        S.has(sensitive, "payment", "biometric", "location").alias("has_sensitive"),
        F.coalesce(F.col("overseas_status") == "detected", F.lit(False)).alias("has_overseas"),
        F.coalesce("overseas_status", F.lit("unknown")).alias("overseas_status"),
        positive("sensitive_count").alias("has_form_data"),
        positive("stored").alias("has_storage"),
        F.array_contains(F.coalesce("storage_categories", none), "account").alias("has_auth_storage"),
        (positive("trackers") | positive("requests_observed")).alias("has_profiling"),
    )


def checks(pages: DataFrame, observed: DataFrame, vendors: DataFrame) -> DataFrame:
    """Applicable checks, one row each: (tab_id, pos, check_id, aligned).

    Six general ones and one per third-party vendor other than delivery networks.
    """
    found, c = F.col("found_sections"), F.col
    general = [
        ("collected_data", c("has_form_data") | c("has_sensitive"), S.has(found, "collected_data")),
        ("tracking", c("has_tracking"), S.has(found, "cookies_tracking")),
        ("third_party", c("has_third_party"), S.has(found, "third_party", "processors")),
        ("retention", c("has_form_data") | c("has_storage"), S.has(found, "retention")),
        ("security", c("has_sensitive") | c("has_auth_storage"), S.has(found, "security")),
        ("overseas_transfer", c("has_overseas"), S.has(found, "overseas_transfer")),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit(name).alias("check_id"), when.alias("applicable"), ok.alias("aligned"))
            for i, (name, when, ok) in enumerate(general)
        ]
    )
    general_rows = pages.join(observed.hint("merge"), "tab_id").select("tab_id", F.inline(rows)).filter("applicable").drop("applicable")
    vendor_rows = vendors.filter(F.col("category") != "cdn_security").select(
        "tab_id",
        F.lit(100).cast("bigint").alias("pos"),
        F.concat_ws("_", F.lit("vendor"), "category", "host").alias("check_id"),
        (F.size("missing") == 0).alias("aligned"),
    )
    return general_rows.unionByName(vendor_rows)


def score(pages: DataFrame, check_rows: DataFrame) -> DataFrame:
    """One row per tab: share of applicable checks that are aligned, its level, and the missing ones."""
    severity = F.when(F.col("check_id").isin("tracking", "collected_data"), "high").otherwise("medium")
    gap = F.struct("pos", "check_id", severity.alias("severity"))
    per_tab = check_rows.groupBy("tab_id").agg(
        F.count("*").alias("applicable"),
        F.count_if("aligned").alias("aligned"),
        F.array_sort(F.collect_list(F.when(~F.col("aligned"), gap))).alias("gaps"),
    )
    joined = pages.select("tab_id").join(per_tab, "tab_id", "left").fillna(0, ["applicable", "aligned"])
    value = F.when(F.col("applicable") == 0, F.lit(100)).otherwise(F.floor(F.col("aligned") / F.col("applicable") * 100 + 0.5))
    findings = F.coalesce(
        F.transform(
            "gaps",
            lambda g: F.struct(
                F.concat(F.lit("alignment_missing_"), g["check_id"]).alias("id"),
                g["severity"].alias("severity"),
                F.lit(None).cast("string").alias("confidence"),
                F.array().cast("array<string>").alias("detail"),
            ).cast(FN.FINDING),
        ),
        F.array().cast(f"array<{FN.FINDING}>"),
    )
    step = joined.withColumn("score", value.cast("bigint"))
    level = F.when(F.col("score") >= 80, "high").when(F.col("score") >= 50, "medium").otherwise("low")
    return step.select("tab_id", "applicable", "aligned", "score", level.alias("level"), findings.alias("findings"))


def cookie_risk(consent: DataFrame, storage: DataFrame, network: DataFrame, choices: DataFrame) -> DataFrame:
    """Worst severity over consent, storage and network findings and the choices offered."""
    found = [r.select("tab_id", F.explode(F.transform("findings", lambda f: f["severity"])).alias("severity")) for r in (consent, storage, network)]
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(choices.select("tab_id", F.col("risk_level").alias("severity")))
    worst = every.groupBy("tab_id").agg(F.max(FN.severity_rank(F.col("severity"))).alias("worst"))
    joined = network.select("tab_id").join(worst, "tab_id", "left")
    level = F.when(F.col("worst") == 3, "high").when(F.col("worst") == 2, "medium").otherwise("low")
    points = F.when(F.col("worst") == 3, 82).when(F.col("worst") == 2, 52).otherwise(18)
    return joined.select("tab_id", level.alias("level"), points.alias("score"))
