"""Queries on policy text: preparation, gate, risks, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions import text as T
from clausetrail.functions.patterns import fold_blanks, matches_any
from clausetrail.operators import policy as P
from clausetrail.operators import sections as S
from clausetrail.operators.settle import settle
from clausetrail.plans.registry import query
from clausetrail.sources.sample_views import load


def policies(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "fx_policies").select("doc_id", "body")


def with_text(spark, sf_dir) -> DataFrame:
    return P.with_text(policies(spark, sf_dir))


def gated(spark, sf_dir) -> DataFrame:
    return P.with_gate(P.with_sentences(with_text(spark, sf_dir)))


@query("src_1_policy_documents")
def _(spark, sf_dir):
    return load(spark, sf_dir, "fx_policies").select("doc_id", "lang", F.length("body").alias("chars"))


@query("txt_1_bounded_text")
def _(spark, sf_dir):
    bounded = P.with_text(policies(spark, sf_dir), max_chars=R.MAX_POLICY_CHARS)
    return bounded.withColumn("kind", F.when(F.col("text") == "", "empty").otherwise("text"))


@query("txt_2_sentences")
def _(spark, sf_dir):
    return P.sentence_rows(policies(spark, sf_dir))


@query("txt_3_overlapping_windows")
def _(spark, sf_dir):
    return P.rows_of(with_text(spark, sf_dir), T.windows(F.col("text")), "window_idx", "window_text", ["doc_id"])


@query("txt_4_clauses")
def _(spark, sf_dir):
    return P.clause_rows(policies(spark, sf_dir))


@query("txt_5_heading_blocks")
def _(spark, sf_dir):
    return P.rows_of(with_text(spark, sf_dir), T.heading_blocks(F.col("text")), "block_idx", "block", ["doc_id"])


@query("txt_6_packed_blocks")
def _(spark, sf_dir):
    return P.rows_of(with_text(spark, sf_dir), T.packed_blocks(F.col("text")), "block_idx", "block", ["doc_id"])


@query("txt_7_block_titles")
def _(spark, sf_dir):
    blocks = S.with_blocks(with_text(spark, sf_dir)).select("doc_id", F.inline_outer("blocks"))
    return blocks.filter(F.col("idx").isNotNull()).select("doc_id", F.col("idx").alias("block_idx"), "title")


@query("txt_8_tokens")
def _(spark, sf_dir):
    return with_text(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@query("txt_9_folded_text")
def _(spark, sf_dir):
    return policies(spark, sf_dir).select("doc_id", fold_blanks(F.col("body")).alias("folded"))


@query("txt_10_excerpts")
def _(spark, sf_dir):
    return policies(spark, sf_dir).select("doc_id", T.excerpt(F.col("body"), R.EXCERPT_CHARS).alias("excerpt"))


@query("txt_13_word_count")
def _(spark, sf_dir):
    return with_text(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("word_count"))


@query("pol_2_leading_markers")
def _(spark, sf_dir):
    text = F.col("text")
    return with_text(spark, sf_dir).select(
        "doc_id",
        P.leads_with(text, R.PRIVACY_MARKER).alias("leading_privacy"),
        P.leads_with(text, R.TERMS_MARKER).alias("leading_terms"),
    )


@query("pol_3_evidence_text")
def _(spark, sf_dir):
    rows = P.sentence_rows(policies(spark, sf_dir))
    rows = rows.select("doc_id", "sent_idx", P.evidence_text(F.col("sentence")).alias("evidence"))
    return rows.filter(~P.expository(F.struct(F.col("evidence").alias("text"))))


def _flag(name: str, key: str) -> None:
    query(key)(lambda spark, sf_dir: gated(spark, sf_dir).select("doc_id", name))


_flag("data_practice", "pol_4_data_practice")
_flag("rights_or_retention", "pol_5_rights_or_retention")
_flag("terms_clause", "pol_6_terms_clause")


@query("pol_7_policy_status")
def _(spark, sf_dir):
    confidence = F.when(F.col("status") != "empty", F.round("policy_confidence", 4))
    return gated(spark, sf_dir).select("doc_id", confidence.alias("policy_confidence"), "status")


@query("pol_8_data_categories")
def _(spark, sf_dir):
    found = with_text(spark, sf_dir).select("doc_id", T.data_categories(T.tokens(F.col("text"))).alias("hits"))
    rows = found.select("doc_id", F.inline_outer("hits")).filter(F.col("id").isNotNull())
    return rows.select("doc_id", F.col("id").alias("category"), F.array_join("matched", "|").alias("matched"))


@query("pol_9_negated_clauses")
def _(spark, sf_dir):
    return P.clause_rows(policies(spark, sf_dir)).filter(matches_any(F.col("clause"), R.NEGATED_DATA_ACTION))


def _risk(number: int, rule_id: str) -> None:
    query(f"pol_{number}_{rule_id}")(lambda spark, sf_dir: P.risk_rows(policies(spark, sf_dir), rule_id))


for _number, _rule in enumerate(
    [
        "broad_data_sharing",
        "children",
        "behavioral_ads",
        "account_termination",
        "policy_change",
        "retention_unclear",
        "overseas_transfer",
        "arbitration",
        "liability_limit",
        "security_vague",
    ],
    start=10,
):
    _risk(_number, _rule)


def analyzed(spark, sf_dir) -> DataFrame:
    return P.analyze(policies(spark, sf_dir)).filter(F.col("status") == "analyzed")


@query("pol_20_risk_evidence")
def _(spark, sf_dir):
    rows = analyzed(spark, sf_dir).select("doc_id", F.inline_outer("risks")).filter(F.col("id").isNotNull())
    return rows.select("doc_id", F.col("id").alias("risk_id"), "severity", "evidence")


@query("pol_21_positives")
def _(spark, sf_dir):
    found = analyzed(spark, sf_dir).select("doc_id", F.array_join("positives", "|").alias("positives"))
    return settle(found).filter(F.col("positives") != "")


@query("pol_22_risk_score")
def _(spark, sf_dir):
    return analyzed(spark, sf_dir).select("doc_id", "score")


@query("pol_23_risk_level")
def _(spark, sf_dir):
    return P.analyze(policies(spark, sf_dir)).select("doc_id", "status", "level")


@query("pol_24_overall_severity")
def _(spark, sf_dir):
    return analyzed(spark, sf_dir).select("doc_id", "overall_severity")


@query("pol_25_ordered_risks")
def _(spark, sf_dir):
    joined = F.array_join(F.transform("risks", lambda r: F.concat_ws(":", r["id"], r["severity"])), "|")
    return settle(analyzed(spark, sf_dir).select("doc_id", joined.alias("risks"))).filter(F.col("risks") != "")


@query("pol_26_section_scores")
def _(spark, sf_dir):
    blocks = S.with_blocks(with_text(spark, sf_dir))
    rows = blocks.select("doc_id", F.inline_outer(S.section_scores(F.col("blocks"))))
    rows = rows.select("doc_id", "section_id", F.inline_outer("scored")).filter(F.col("idx").isNotNull())
    return rows.select("doc_id", F.col("idx").alias("block_idx"), "section_id", (-F.col("order")).alias("score"))


@query("pol_27_sections")
def _(spark, sf_dir):
    rows = S.section_rows(policies(spark, sf_dir))
    return rows.select(
        "doc_id",
        "section_id",
        "found",
        F.array_join(F.transform("evidence", lambda e: e["title"]), "|").alias("titles"),
        F.array_join(F.transform("evidence", lambda e: e["excerpt"]), "|").alias("excerpts"),
    )


@query("pol_28_section_presence")
def _(spark, sf_dir):
    return S.presence(policies(spark, sf_dir)).withColumn("any_recipient", F.col("third_party") | F.col("processors"))


@query("pol_29_disclosed_categories")
def _(spark, sf_dir):
    facts = S.policy_facts(policies(spark, sf_dir)).select("doc_id", F.array_join("disclosed", "|").alias("disclosed"))
    return facts.filter(F.col("disclosed") != "")
