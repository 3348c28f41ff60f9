"""One record per page: counts, categories and findings, free of the values behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausetrail.functions import urls as U
from clausetrail.functions.patterns import let
from clausetrail.operators.network import with_document


def bare_findings(found: Column) -> Column:
    """Findings without their detail."""
    return F.transform(
        found,
        lambda f: F.struct(f["id"].alias("id"), f["severity"].alias("severity"), F.coalesce(f["confidence"], F.lit("")).alias("confidence")),
    )


def report_url(url: Column) -> Column:
    def short(p: Column) -> Column:
        return F.concat(U.origin(p), U.minimal_path(p["path"], 6, 240))

    return F.coalesce(let(U.parts(url), lambda p: F.when(p.isNotNull(), short(p))), F.lit(""))


def site_reports(
    sites: DataFrame,
    policy: DataFrame,
    network: DataFrame,
    forms: DataFrame,
    storage: DataFrame,
    consent: DataFrame,
    delta: DataFrame,
    jurisdiction: DataFrame,
    alignment: DataFrame,
) -> DataFrame:
    """All analyses of a page side by side: (tab_id, source, policy, network, ..., alignment).

    Every input has at most one row per tab, so the joins share one partitioning and move small rows.  All are merge
    joins: a stage that is small as a file unfolds to many times its size, and as broadcasts all of them would pass
    through the driver.
    """
    source = F.struct(F.col("page_host").alias("title"), report_url(F.col("page_url")).alias("url"))
    base = sites.select("tab_id", "doc_id", source.alias("source"))
    policy_part = policy.select(
        "doc_id",
        F.struct(
            "status",
            "level",
            "score",
            "word_count",
            F.transform("data_categories", lambda c: c["id"]).alias("data_categories"),
            F.transform("risks", lambda r: F.struct(r["id"].alias("id"), r["severity"].alias("severity"))).alias("risks"),
            "positives",
        ).alias("policy"),
    )
    bare = bare_findings(F.col("findings")).alias("findings")
    vendor = F.transform(
        "vendor_summary",
        lambda v: F.struct(*[v[n].alias(n) for n in ("vendor", "host", "category", "risk", "missing")]),
    )
    parts = {
        "network": (
            network,
            [
                "request_count",
                "third_party_hosts",
                "tracker_hosts",
                vendor.alias("vendors"),
                F.size("sensitive_fields").alias("sensitive_field_count"),
            ],
        ),
        "form": (
            forms,
            [
                "field_count",
                "sensitive_count",
                F.transform("categories", lambda c: F.struct(c["category"].alias("id"), c["n"].alias("fields"), c["required"].alias("required"))).alias("categories"),
            ],
        ),
        "storage": (
            storage,
            [
                "local_keys",
                "session_keys",
                "cookie_count",
                "third_party_cookies",
                F.transform("classified", lambda c: F.struct(c["category"].alias("id"), F.size(c["keys"]).alias("keys"))).alias("categories"),
            ],
        ),
        "consent": (
            consent,
            [
                "detected",
                "banner_count",
                "reject_available",
                "accept_available",
                "preference_available",
                "choice_kind",
                "requests_before",
                "requests_after",
                "cookies_before",
                "cookies_after",
                "disabled_toggles",
            ],
        ),
        "delta": (delta, ["request_delta", "cookie_delta", "tracking_requests", "tracking_cookies"]),
        "jurisdiction": (jurisdiction, ["code", "confidence"]),
        "alignment": (alignment, ["score", "level"]),
    }
    rows = [df.select("tab_id", F.struct(*columns, bare).alias(name)) for name, (df, columns) in parts.items()]
    # The document first, while rows are narrow; pages without one are many and are spread.
    joined = reduce(lambda left, right: left.join(right.hint("merge"), "tab_id", "left"), rows, with_document(base, policy_part))
    return joined.select("tab_id", "source", "policy", *parts)


def as_json(reports: DataFrame) -> DataFrame:
    """(tab_id, record): the report of a page as one JSON document."""
    body = F.struct("source", F.struct(*[c for c in reports.columns if c not in ("tab_id", "source")]).alias("analysis"))
    return reports.select("tab_id", F.to_json(body).alias("record"))


def write_reports(reports: DataFrame, path: str, partitions: int | None = None) -> None:
    """Writes the records as JSON lines, replacing earlier output at ``path``."""
    out = as_json(reports)
    (out.repartition(partitions, "tab_id") if partitions else out).select("record").write.mode("overwrite").text(path)
