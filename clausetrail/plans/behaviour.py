"""Queries on consent, regimes, alignment and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausetrail.functions import findings as FN
from clausetrail.operators import alignment as A
from clausetrail.operators import consent as C
from clausetrail.operators import jurisdiction as J
from clausetrail.operators import report as RP
from clausetrail.plans.inputs import inputs
from clausetrail.plans.registry import query


def payloads(spark, sf_dir):
    """Consent records as the JSON documents they are captured as."""
    rows = inputs(spark, sf_dir).consents
    record = F.struct(
        "detected",
        F.unix_millis("observed_from").cast("string").alias("observed_from"),
        F.date_format("choice_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("choice_at"),
        "choice_kind",
        "containers",
    )
    return rows.select("tab_id", F.to_json(record).alias("payload"))


@query("src_9_consent_records")
def _(spark, sf_dir):
    parsed = C.parse_payloads(payloads(spark, sf_dir))
    buttons = F.flatten(F.transform("containers", lambda c: c["buttons"]))
    toggles = F.flatten(F.transform("containers", lambda c: c["toggles"]))
    return parsed.select("tab_id", "detected", "choice_kind", F.size(buttons).alias("buttons"), F.size(toggles).alias("toggles"))


@query("con_1_button_types")
def _(spark, sf_dir):
    rows = inputs(spark, sf_dir).consents.select("tab_id", F.explode("containers").alias("c"))
    buttons = rows.select("tab_id", F.posexplode("c.buttons").alias("pos", "button"))
    return buttons.withColumn("type", C.button_type(F.col("button")))


@query("con_2_recorded_choices")
def _(spark, sf_dir):
    rows = inputs(spark, sf_dir).consents.select("tab_id", "choice_kind", F.explode("containers").alias("c"))
    buttons = rows.select("tab_id", "choice_kind", F.posexplode("c.buttons").alias("pos", "button"))
    return buttons.select(
        "tab_id", "pos", F.coalesce(C.recorded_choice(F.col("button")), F.lit("")).alias("clicked"), C.choice_kind(F.col("choice_kind")).alias("recorded")
    )


@query("con_4_consent_categories")
def _(spark, sf_dir):
    rows = inputs(spark, sf_dir).consents.select("tab_id", F.posexplode(C.categories(F.col("containers"))).alias("place", "c"))
    return rows.select("tab_id", "place", F.col("c.id").alias("category"), "c.risk", "c.enabled")


@query("con_5_allowed_categories")
def _(spark, sf_dir):
    rows = C.choices(inputs(spark, sf_dir).consents)
    return rows.select("tab_id", "type", "label", F.array_join(F.transform("allowed", lambda c: c["id"]), "|").alias("allowed"))


@query("con_6_choice_risk")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).choices.select("tab_id", "type", "label", "risk_level")


@query("con_7_choice_concerns")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).choices.select("tab_id", "type", "label", F.array_join("concerns", "|").alias("concerns"))


@query("con_8_distinct_choices")
def _(spark, sf_dir):
    return C.choices(inputs(spark, sf_dir).consents).select("tab_id", "pos", "type", "label", "synthetic")


@query("con_9_timeline")
def _(spark, sf_dir):
    return C.timeline(C.parse_payloads(payloads(spark, sf_dir))).select(
        "tab_id", "observed_from", "boundary_at", "boundary_type", "choice_kind", "confidence"
    )


@query("con_10_request_buckets")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).request_timing


@query("con_11_cookie_evidence")
def _(spark, sf_dir):
    return C.cookie_evidence(inputs(spark, sf_dir).cookies)


@query("con_12_cookie_buckets")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).cookie_timing


@query("con_13_disabled_toggles")
def _(spark, sf_dir):
    return C.disabled_toggles(inputs(spark, sf_dir).consents)


def _consent(key: str, *ids: str) -> None:
    query(key)(lambda spark, sf_dir: C.finding_rows(inputs(spark, sf_dir).consent, *ids))


_consent("con_14_tracking_without_visible_consent", "tracking_without_visible_consent")
_consent("con_15_tracking_before_clear_choice", "tracking_before_clear_choice")
_consent("con_16_missing_reject_options", "consent_no_reject_option", "reject_hidden_in_preferences")
_consent("con_17_tracking_after_rejection", "tracking_after_rejection")
_consent("con_18_tracking_despite_disabled_toggle", "tracking_despite_disabled_toggle")


@query("str_15_baseline_counts")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).baselines


@query("dlt_1_after_baseline")
def _(spark, sf_dir):
    rows = inputs(spark, sf_dir).delta
    return rows.withColumn("findings", FN.id_severities(F.col("findings")))


@query("jur_1_jurisdictions")
def _(spark, sf_dir):
    return J.detect(inputs(spark, sf_dir).sites)


def _regime(key: str, code: str) -> None:
    @query(key)
    def _(spark, sf_dir):
        """Every page checked against one regime, whichever applies to it."""
        x = inputs(spark, sf_dir)
        found = {"GDPR": J.gdpr_findings, "KR": J.korean_findings, "US": J.us_findings}[code]()
        rows = x.pages.join(x.observed.hint("merge"), "tab_id").select("tab_id", F.explode(found).alias("f"))
        return rows.select("tab_id", F.col("f.id").alias("finding"), F.col("f.severity").alias("severity"), F.array_join("f.detail", "|").alias("detail"))


_regime("jur_2_gdpr_checks", "GDPR")
_regime("jur_3_korea_checks", "KR")
_regime("jur_4_us_checks", "US")


@query("jur_5_applicable_findings")
def _(spark, sf_dir):
    rows = inputs(spark, sf_dir).jurisdiction
    return rows.select("tab_id", "code", FN.id_severities(F.col("findings")).alias("findings"))


@query("obs_1_observed_signals")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).observed


@query("obs_2_overseas_transfer")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).overseas.select("tab_id", F.coalesce("source", F.lit("")).alias("source"), "overseas_status")


@query("aln_1_alignment_checks")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).checks.select("tab_id", "check_id", "aligned")


@query("aln_2_alignment_score")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).alignment.select("tab_id", "applicable", "aligned", "score", "level", F.size("findings").alias("findings"))


@query("ckr_1_cookie_risk")
def _(spark, sf_dir):
    x = inputs(spark, sf_dir)
    return A.cookie_risk(x.consent, x.storage, x.network, x.choices)


@query("rep_1_site_reports")
def _(spark, sf_dir):
    rows = inputs(spark, sf_dir).reports
    return rows.select(
        "tab_id",
        F.col("source.url").alias("url"),
        F.col("policy.level").alias("policy_level"),
        F.col("network.request_count").alias("requests"),
        F.col("form.field_count").alias("fields"),
        F.col("storage.cookie_count").alias("cookies"),
        F.col("consent.banner_count").alias("banners"),
        F.col("delta.request_delta").alias("request_delta"),
        F.col("jurisdiction.code").alias("jurisdiction"),
        F.col("alignment.score").alias("alignment"),
    )


@query("snk_1_report_records")
def _(spark, sf_dir):
    return RP.as_json(inputs(spark, sf_dir).reports)


@query("snk_1_report_fields")
def _(spark, sf_dir):
    """Fields of the written records, read from their text."""
    records = RP.as_json(inputs(spark, sf_dir).reports)
    field = lambda path, kind: F.get_json_object("record", f"$.{path}").cast(kind)
    return records.select(
        "tab_id",
        field("source.url", "string").alias("url"),
        field("analysis.policy.level", "string").alias("policy_level"),
        field("analysis.network.request_count", "bigint").alias("requests"),
        field("analysis.form.field_count", "bigint").alias("fields"),
        field("analysis.storage.cookie_count", "bigint").alias("cookies"),
        field("analysis.consent.banner_count", "bigint").alias("banners"),
        field("analysis.delta.request_delta", "bigint").alias("request_delta"),
        field("analysis.jurisdiction.code", "string").alias("jurisdiction"),
        field("analysis.alignment.score", "bigint").alias("alignment"),
    )
