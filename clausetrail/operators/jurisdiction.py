"""Which privacy regime applies to a page and what its policy then has to say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions import findings as FN
from clausetrail.functions.patterns import any_of, text_list
from clausetrail.operators import sections as S


def detect(sites: DataFrame) -> DataFrame:
    """(tab_id, code, confidence, basis).  A known country decides; otherwise host, language and time zone vote."""
    country = F.upper(F.coalesce("country_code", F.lit("")))
    language, zone, host = (F.lower(F.coalesce(c, F.lit(""))) for c in ("language", "time_zone", "page_host"))
    spoken = F.split_part(language, F.lit("-"), F.lit(1))
    tld = F.element_at(F.split(host, r"\."), -1)
    us_zone = zone.isin(R.US_TIME_ZONES) | any_of([F.startswith(zone, F.lit(p)) for p in R.US_TIME_ZONE_PREFIXES])
    dotted = F.contains(host, F.lit("."))
    votes = {
        "KR": (dotted & (tld == "kr"), spoken == "ko", zone == "asia/seoul"),
        "GDPR": (dotted & tld.isin(R.EU_TLDS), spoken.isin(R.EU_LANGUAGES), zone.isin(R.EU_TIME_ZONES)),
        "US": (dotted & (tld == "us"), language == "en-us", us_zone),
    }
    scored = sites.select(
        "tab_id",
        country.alias("country"),
        *[(h.cast("int") * 3 + s.cast("int") + z.cast("int")).alias(code) for code, (h, s, z) in votes.items()],
    )
    top = F.greatest(*votes)
    tied = sum(((F.col(code) == top).cast("int") for code in votes), F.lit(0)) > 1
    winner = F.when(F.col("KR") == top, "KR").when(F.col("GDPR") == top, "GDPR").otherwise("US")
    by_country = F.when(F.col("country").isin(R.EU_COUNTRIES), "GDPR").when(F.col("country").isin("KR", "US"), F.col("country"))
    code = F.when(F.col("country") != "", F.coalesce(by_country, F.lit("GENERAL"))).when((top == 0) | tied, "GENERAL").otherwise(winner)
    step = scored.withColumn("code", code)
    sure = (F.col("code") != "GENERAL") & ((F.col("country") != "") | (top >= 3))
    basis = (
        F.when(F.col("code") == "GENERAL", "uncertain")
        .when(F.col("country") != "", "country")
        .otherwise(F.concat(F.lower("code"), F.lit("_signal")))
    )
    return step.select("tab_id", "code", F.when(sure, "medium").otherwise("low").alias("confidence"), basis.alias("basis"))


def _missing(code: str) -> Column:
    return F.array_except(text_list(R.CORE_SECTIONS[code]), F.col("found_sections"))


def gdpr_findings() -> Column:
    found, c = F.col("found_sections"), F.col
    missing = _missing("GDPR")
    return FN.findings(
        FN.finding(F.size(missing) > 0, "gdpr_missing_core_information", "high", missing),
        FN.finding(c("has_tracking") & ~S.has(found, "cookies_tracking"), "gdpr_tracking_without_specific_consent_notice", "high"),
        FN.finding(c("has_overseas") & ~S.has(found, "overseas_transfer"), "gdpr_transfer_without_safeguards_notice", "high"),
        FN.finding(c("has_sensitive") & ~c("mentions_special_category"), "gdpr_special_category_without_notice", "high"),
        FN.finding(c("has_profiling") & ~S.has(found, "automated_decision"), "gdpr_profiling_without_notice", "medium"),
    )


def korean_findings() -> Column:
    found, c = F.col("found_sections"), F.col
    return FN.findings(
        FN.finding(F.size(_missing("KR")) > 0, "kr_missing_core_policy_sections", "high", _missing("KR")),
        FN.finding(c("has_third_party") & ~S.has(found, "third_party", "processors"), "kr_third_party_without_disclosure", "high"),
        FN.finding(c("has_tracking") & ~S.has(found, "cookies_tracking"), "kr_tracking_without_cookie_section", "medium"),
        FN.finding(c("has_overseas") & ~S.has(found, "overseas_transfer"), "kr_overseas_transfer_without_disclosure", "medium"),
    )


def us_findings() -> Column:
    found, c = F.col("found_sections"), F.col
    return FN.findings(
        FN.finding(F.size(_missing("US")) > 0, "us_missing_transparency_sections", "medium", _missing("US")),
        FN.finding(c("has_tracking") & ~S.has(found, "cookies_tracking"), "us_tracking_without_optout_notice", "high"),
        FN.finding(c("has_sensitive") & ~c("mentions_sensitive_us"), "us_sensitive_data_without_notice", "high"),
        FN.finding(S.has(found, "children") & ~c("mentions_parental"), "us_children_without_parental_consent", "high"),
    )


def check(pages: DataFrame, observed: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """One row per tab with the findings of the regime that applies."""
    joined = jurisdictions.join(pages.hint("merge"), "tab_id").join(observed.hint("merge"), "tab_id")
    code = F.col("code")
    found = (
        F.when(code == "GDPR", gdpr_findings())
        .when(code == "KR", korean_findings())
        .when(code == "US", us_findings())
        .otherwise(FN.findings(FN.finding(F.lit(True), "jurisdiction_uncertain", "low")))
    )
    return joined.select("tab_id", "code", "confidence", found.alias("findings"))
