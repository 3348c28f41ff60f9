"""Queries on the observation side: sessions, sampling, queues, and their streams; pages and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clausetrail.functions.patterns import trim_blanks
from clausetrail.operators import cookies as K
from clausetrail.operators import labels as L
from clausetrail.operators import pages as PG
from clausetrail.operators import policy as P
from clausetrail.operators import requests as RQ
from clausetrail.plans.inputs import inputs
from clausetrail.plans.registry import query
from clausetrail.plans.stages import stage_root
from clausetrail.sources.html import extract_text
from clausetrail.sources.sample_views import load_stream
from clausetrail.streaming import jobs
from clausetrail.streaming import ordered as OR
from clausetrail.streaming import sessions as SE
from clausetrail.streaming.rate_limit import sample, sample_stream

# Small parameters, so that limits are reached by the sparse sample events.
BUCKET, REFILL = 2, 1 / 43_200


@query("txt_11_visible_text")
def _(spark, sf_dir):
    return extract_text(inputs(spark, sf_dir).view("fx_fetches").select("fetch_id", "body"))


@query("pol_1_page_gate")
def _(spark, sf_dir):
    policies = inputs(spark, sf_dir).view("fx_policies")
    lines = F.split("body", "\n")
    pages = policies.select(
        "doc_id",
        F.concat(F.lit("/"), "lang", F.when(F.length("body") > 1500, "/legal/privacy").otherwise("/about")).alias("path"),
        lines[0].alias("title"),
        F.filter(lines, lambda h: F.length(h) < 40).alias("headings"),
        trim_blanks(F.col("body")).alias("text"),
    )
    return PG.page_gate(pages).select("doc_id", F.round("gate_score", 4).alias("gate_score"), "confidence", "policy_like")


@query("pol_30_summaries")
def _(spark, sf_dir):
    policies = inputs(spark, sf_dir).view("fx_policies").select("doc_id", "body")
    return L.summary(P.analyze(policies).filter(F.col("status") == "analyzed"), "en")


@query("pol_31_labelled_risks")
def _(spark, sf_dir):
    policies = inputs(spark, sf_dir).view("fx_policies").select("doc_id", "body")
    rows = P.analyze(policies).select("doc_id", F.inline_outer("risks")).filter(F.col("id").isNotNull())
    rows = rows.select("doc_id", F.col("id").alias("risk_id"))
    return L.with_label(rows, L.label_table(spark), F.concat(F.lit("risk."), "risk_id"), "fr")


@query("str_1_session_rotation")
def _(spark, sf_dir):
    return SE.rotate(inputs(spark, sf_dir).requests).select("request_id", "tab_id", "session_no")


@query("str_1_sessions")
def _(spark, sf_dir):
    return SE.sessions(SE.rotate(inputs(spark, sf_dir).requests))


@query("str_2_visits")
def _(spark, sf_dir):
    return SE.visits(inputs(spark, sf_dir).requests)


@query("str_2_visit_numbers")
def _(spark, sf_dir):
    return SE.with_inactivity(inputs(spark, sf_dir).requests).select("request_id", "tab_id", "visit_no")


@query("str_3_session_members")
def _(spark, sf_dir):
    requests = inputs(spark, sf_dir).requests
    return SE.in_session(requests, SE.current_sessions(SE.rotate(requests))).select("request_id", "tab_id")


@query("str_4_stale_rejection")
def _(spark, sf_dir):
    return SE.drop_stale(SE.rotate(inputs(spark, sf_dir).requests)).select("request_id", "tab_id", "session_no")


@query("str_5_rate_sampling")
def _(spark, sf_dir):
    return sample(inputs(spark, sf_dir).requests, BUCKET, REFILL)


def from_stream(spark, stream, name: str):
    """Runs a stream over what is available and reads back the files it wrote."""
    base = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    running = jobs.to_files(stream, f"{base}/out", f"{base}/checkpoint")
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def request_stream(spark, sf_dir):
    return RQ.minimise(load_stream(spark, sf_dir, "fx_requests").withColumn("ts", F.col("ts").cast("timestamp")))


def from_batches(spark, name: str, start, columns: str):
    """Runs a job that writes a folder for each micro-batch, and reads these back."""
    base = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    start(f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(columns).parquet(f"{base}/out").drop("epoch")


@query("str_5_rate_sampling_stream")
def _(spark, sf_dir):
    rows = request_stream(spark, sf_dir)
    return from_batches(spark, "sampled", lambda *to: sample_stream(rows, *to, BUCKET, REFILL), "request_id bigint, tab_id bigint, allowed boolean")


@query("str_1_session_rotation_stream")
def _(spark, sf_dir):
    rows = request_stream(spark, sf_dir)
    return from_batches(spark, "rotated", lambda *to: OR.rotate(rows, *to), "request_id bigint, tab_id bigint, session_no bigint")


@query("str_2_visit_numbers_stream")
def _(spark, sf_dir):
    rows = request_stream(spark, sf_dir)
    return from_batches(spark, "visits", lambda *to: OR.number_visits(rows, *to), "request_id bigint, tab_id bigint, visit_no bigint")


@query("str_3_session_members_stream")
def _(spark, sf_dir):
    rows = request_stream(spark, sf_dir).select("tab_id", "ts", "request_id", "resource_type")
    starts = request_stream(spark, sf_dir).filter("resource_type = 'main_frame'")
    return from_batches(spark, "members", lambda *to: OR.members(rows, starts, *to), "request_id bigint, tab_id bigint")


@query("str_4_stale_rejection_stream")
def _(spark, sf_dir):
    rows = request_stream(spark, sf_dir)
    return from_batches(spark, "generations", lambda *to: OR.current_generation(rows, *to), "request_id bigint, tab_id bigint, session_no bigint")


@query("str_13_effective_updates_stream")
def _(spark, sf_dir):
    rows = request_stream(spark, sf_dir).withColumn("explicit", F.col("method") != "GET")
    return from_batches(spark, "updates", lambda *to: OR.effective_updates(rows, *to, 12 * 3_600), "request_id bigint, tab_id bigint, explicit boolean")


@query("str_16_changed_scans_stream")
def _(spark, sf_dir):
    scans = request_stream(spark, sf_dir).withColumn("fingerprint", F.col("scheme"))
    return from_batches(spark, "scans", lambda *to: OR.changed_scans(scans, *to), "request_id bigint, tab_id bigint")


def change_stream(spark, sf_dir):
    changes = load_stream(spark, sf_dir, "fx_cookie_changes")
    return K.with_identity(changes.withColumn("ts", F.col("ts").cast("timestamp")))


@query("str_8_fair_queue_stream")
def _(spark, sf_dir):
    """The time batches that are closed when the newest change is an hour past their end."""
    rows = change_stream(spark, sf_dir)
    columns = "change_id bigint, batch_start timestamp, turn int, place int"
    return from_batches(spark, "queue", lambda *to: OR.fair_queue(rows, *to, "1 day", 3_600, 10, 50), columns)


@query("str_10_cookie_state_stream")
def _(spark, sf_dir):
    base = f"{stage_root(spark)}/cookies-{uuid.uuid4().hex}"
    OR.cookie_state(change_stream(spark, sf_dir), f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return OR.cookies_now(inputs(spark, sf_dir).changes, f"{base}/table").select(
        "tab_id", "identity", "name", "domain", "removed", "observed", "first_set_at", "last_set_at", "deleted_at"
    )


@query("src_7_minimised_requests_stream")
def _(spark, sf_dir):
    stream = jobs.requests_in(load_stream(spark, sf_dir, "fx_requests")).select("request_id", "tab_id", "host", "path", "method")
    return from_stream(spark, stream, "requests")


@query("str_6_last_requests")
def _(spark, sf_dir):
    return SE.last_events(inputs(spark, sf_dir).requests, 30).select("request_id", "tab_id", "place")


@query("str_7_cookie_batches")
def _(spark, sf_dir):
    return K.coalesce_changes(inputs(spark, sf_dir).changes, "1 day").select(
        "tab_id", "identity", "batch_start", "changes", "name", "removed", "first_set_at", "last_set_at", "deleted_at"
    )


@query("str_8_fair_queue")
def _(spark, sf_dir):
    changes = inputs(spark, sf_dir).changes.withColumn("batch_start", F.date_trunc("day", "ts"))
    return K.fair_queue(changes, 10, 50).select("change_id", "batch_start", "turn", "place")


@query("str_12_exclusion_after_attribution")
def _(spark, sf_dir):
    x = inputs(spark, sf_dir)
    tabs = x.sites.select("tab_id", F.concat(F.lit("https://"), "page_host").alias("origin"))
    excluded = x.sites.filter(F.col("language") == "fr-FR").select(F.concat(F.lit("https://"), "page_host").alias("origin")).distinct()
    return SE.paused_out(x.attributed, x.site_tabs, tabs, excluded)


@query("str_11_attribution_stream")
def _(spark, sf_dir):
    """Changes against the tabs that top-level documents of the same stream have opened."""
    pages = inputs(spark, sf_dir).sites.select("tab_id", F.col("page_url").alias("url"))
    opened = request_stream(spark, sf_dir).filter("resource_type = 'main_frame'").select("tab_id", "ts", "request_id").join(pages, "tab_id")
    changes = change_stream(spark, sf_dir)
    return from_batches(spark, "attributed", lambda *to: OR.attribution(changes, opened, *to), "change_id bigint, tab_id bigint, site string")


def updates(spark, sf_dir):
    """Writes stand for explicit analyses, other requests for automatic scans; the scheme gives the level."""
    level = F.when(F.col("scheme") == "http", "high").otherwise("low")
    return inputs(spark, sf_dir).requests.select("tab_id", "ts", "request_id", (F.col("method") != "GET").alias("explicit"), level.alias("level"))


@query("str_13_effective_updates")
def _(spark, sf_dir):
    return SE.indicator_updates(updates(spark, sf_dir), 12 * 3_600).select("request_id", "tab_id", "explicit")


@query("str_13_indicators")
def _(spark, sf_dir):
    return SE.indicators(updates(spark, sf_dir))


@query("str_14_recent_tabs")
def _(spark, sf_dir):
    return SE.recent_tabs(inputs(spark, sf_dir).requests)


@query("str_16_changed_scans")
def _(spark, sf_dir):
    scans = inputs(spark, sf_dir).requests.select("tab_id", "ts", "request_id", F.col("scheme").alias("fingerprint"))
    return SE.changed_scans(scans).select("request_id", "tab_id")
