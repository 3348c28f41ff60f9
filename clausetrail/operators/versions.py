"""Saved policy versions: what changed, whether it matters, whom to tell, how checks are going."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions import findings as FN
from clausetrail.functions.patterns import fold_blanks, matches, text_list
from clausetrail.operators import policy as P
from clausetrail.operators import sections as S
from clausetrail.operators.sequences import with_previous

SECTION = "array<struct<id:string,found:boolean,hash:string,excerpt:string>>"


def build(captures: DataFrame) -> DataFrame:
    """Version rows of captured texts: (url_key, version, captured_at, hashes, sections, risks, level, score, status).

    One pass over each text: gate, sections and risks share the row.
    """
    folded = fold_blanks(F.col("body"))
    base = captures.select(F.struct("url_key", "version", "captured_at", F.sha2(folded, 256).alias("text_hash"), F.length(folded).alias("text_length")).alias("key"), "body")
    analyzed = P.analyze(base, "key", extend=S.with_sections, keep=("sections",))

    def row(s: Column) -> Column:
        excerpts = F.transform(s["evidence"], lambda e: e["excerpt"])
        return F.struct(
            s["section_id"].alias("id"),
            s["found"].alias("found"),
            F.sha2(F.array_join(excerpts, "\n"), 256).alias("hash"),
            F.coalesce(F.try_element_at(excerpts, F.lit(1)), F.lit("")).alias("excerpt"),
        )

    return analyzed.select(
        "key.*",
        (F.col("key.text_length") > R.MAX_VERSION_TEXT_CHARS).alias("truncated"),
        F.transform("sections", row).alias("sections"),
        F.transform("risks", lambda r: r["id"]).alias("risk_ids"),
        "level",
        "score",
        "status",
    )


def section_changes(before: Column, after: Column) -> Column:
    """Added, removed and modified sections.

    "Added" needs a previous version without a row for the section; a row that says "not found" is no change.
    """

    def change(id: Column) -> Column:
        old = F.try_element_at(F.filter(before, lambda s: s["id"] == id), F.lit(1))
        new = F.try_element_at(F.filter(after, lambda s: s["id"] == id), F.lit(1))
        was, now = F.coalesce(old["found"], F.lit(False)), F.coalesce(new["found"], F.lit(False))
        kind = F.when(old.isNull() & now, "added").when(was & ~now, "removed").when(was & now & (old["hash"] != new["hash"]), "modified")
        modified = kind == "modified"
        return F.struct(
            id.alias("id"),
            kind.alias("change_type"),
            F.when(modified, old["excerpt"]).otherwise("").alias("before"),
            F.when(modified, new["excerpt"]).otherwise("").alias("after"),
        )

    ids = F.array_union(F.transform(before, lambda s: s["id"]), F.transform(after, lambda s: s["id"]))
    return F.filter(F.transform(ids, change), lambda c: c["change_type"].isNotNull())


def high_impact(change: Column) -> Column:
    before, after = F.lower(change["before"]), F.lower(change["after"])
    widened = matches(before, R.PERMISSION_WITHHELD, False) & matches(after, R.PERMISSION_GRANTED, False)
    new_tracking = ~matches(before, R.TRACKING_WORDING, False) & matches(after, R.TRACKING_WORDING, False)
    return change["id"].isin(R.IMPORTANT_CHANGE_SECTIONS) | widened | new_tracking


def compare(versions: DataFrame) -> DataFrame:
    """Each version against the one before it of the same URL; first versions are not listed."""
    held = F.struct("captured_at", "text_hash", "sections", "risk_ids")
    pairs = with_previous(versions, "url_key", "captured_at", "version", held)
    pairs = pairs.filter(F.col("previous").isNotNull())
    step = (
        pairs.withColumn("section_changes", section_changes(F.col("previous.sections"), F.col("sections")))
        .withColumn("added_risks", F.array_except("risk_ids", "previous.risk_ids"))
        .withColumn("removed_risks", F.array_except("previous.risk_ids", "risk_ids"))
        .withColumn("text_changed", F.col("text_hash") != F.col("previous.text_hash"))
    )
    sections = F.size("section_changes") > 0
    changed = F.col("text_changed") | sections | (F.size("added_risks") > 0) | (F.size("removed_risks") > 0)
    found = FN.findings(
        FN.finding(F.col("text_changed"), "policy_text_changed", "medium"),
        FN.finding(sections, "policy_sections_changed", F.when(F.exists("section_changes", high_impact), "high").otherwise("medium")),
        FN.finding(F.size("added_risks") > 0, "policy_new_risks_added", "high"),
    )
    return step.select(
        "url_key",
        "version",
        "captured_at",
        F.col("previous.captured_at").alias("previous_at"),
        F.col("previous.text_hash").alias("previous_hash"),
        "text_hash",
        "status",
        "text_changed",
        "section_changes",
        "added_risks",
        "removed_risks",
        changed.alias("changed"),
        found.alias("findings"),
    )


def worth_telling(comparisons: DataFrame) -> DataFrame:
    """Changes that touch a notable section or add a risk."""
    ids = F.transform("section_changes", lambda c: c["id"])
    return comparisons.filter(F.col("changed") & (F.arrays_overlap(ids, text_list(R.NOTIFY_SECTIONS)) | (F.size("added_risks") > 0)))


def with_dedupe_key(comparisons: DataFrame) -> DataFrame:
    changes = F.array_sort(F.transform("section_changes", lambda c: F.concat_ws(":", c["id"], c["change_type"])))
    text = F.concat_ws(":", "url_key", "text_hash", F.array_join(changes, "|"), F.array_join(F.array_sort("added_risks"), "|"))
    return comparisons.withColumn("dedupe_key", F.sha2(text, 256))


def not_yet_sent(changes: DataFrame, sent: DataFrame) -> DataFrame:
    """Changes whose key was not sent before.  ``sent``: (dedupe_key)."""
    return changes.join(sent.select("dedupe_key").distinct(), "dedupe_key", "left_anti")


def still_current(changes: DataFrame, live: DataFrame) -> DataFrame:
    """Changes whose baseline is still the live one.  ``live``: (url_key, captured_at, text_hash)."""
    baseline = live.select("url_key", F.col("captured_at").alias("previous_at"), F.col("text_hash").alias("previous_hash"))
    return changes.join(baseline, ["url_key", "previous_at", "previous_hash"], "left_semi")


def notifications(changes: DataFrame) -> DataFrame:
    """(url_key, version, message): host, at most four sections and three new risks, by id."""
    named = F.filter(F.transform("section_changes", lambda c: c["id"]), lambda i: i.isin(R.NOTIFY_SECTIONS))
    sections, risks = F.array_join(F.slice(named, 1, 4), ", "), F.array_join(F.slice("added_risks", 1, 3), ", ")
    parts = F.array_compact(
        F.array(F.when(sections != "", F.concat(F.lit("sections: "), sections)), F.when(risks != "", F.concat(F.lit("new risks: "), risks)))
    )
    host = F.regexp_extract("url_key", "^https://([^/]+)", 1)
    return changes.select("url_key", "version", F.concat_ws(" - ", host, F.array_join(parts, " / ")).alias("message"))


# -- the saved table --------------------------------------------------------------------


def upsert(saved: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest baseline per key of both tables; aggregates before the shuffle."""
    columns = [c for c in saved.columns if c != "url_key"]
    every = saved.unionByName(incoming.select(*saved.columns))
    newest = every.groupBy("url_key").agg(F.max_by(F.struct(*columns), F.struct("captured_at", "version")).alias("r"))
    return newest.select("url_key", "r.*")


def prune(items: DataFrame, count: int = R.MAX_VERSIONS, max_bytes: int = R.MAX_VERSION_BYTES) -> DataFrame:
    """The newest ``count`` items of each tenant that fit a byte budget, taken greedily.

    Items: (tenant, url_key, captured_at, bytes).  Ranking is cut before the shuffle and a tenant keeps at
    most ``count`` rows, so the fold runs over a bounded array.
    """
    newest = Window.partitionBy("tenant").orderBy(F.desc("captured_at"), F.desc("url_key"))
    top = items.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= count)
    listed = top.groupBy("tenant").agg(F.array_sort(F.collect_list(F.struct("place", "url_key", "captured_at", "bytes"))).alias("items"))
    start = F.struct(F.lit(2).cast("bigint").alias("used"), F.array().cast("array<int>").alias("kept"))

    def take(state: Column, item: Column) -> Column:
        fits = (item["bytes"] <= max_bytes) & ((F.size(state["kept"]) == 0) | (state["used"] + item["bytes"] <= max_bytes))
        return F.struct(
            F.when(fits, state["used"] + item["bytes"]).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["kept"], F.array(item["place"]))).otherwise(state["kept"]).alias("kept"),
        )

    chosen = listed.withColumn("kept", F.aggregate("items", start, take, lambda s: s["kept"]))
    rows = chosen.select("tenant", F.inline(F.filter("items", lambda i: F.array_contains(F.col("kept"), i["place"]))))
    return rows.select("tenant", "url_key", "captured_at", "bytes")


# -- checks -----------------------------------------------------------------------------


def due(baselines: DataFrame, health: DataFrame, now: Column, minutes: int = R.POLICY_CHECK_INTERVAL_MINUTES) -> DataFrame:
    """Baselines whose last attempt, or else capture, is long enough ago or unknown."""
    joined = baselines.select("url_key", "captured_at").join(health.select("url_key", "last_attempt_at"), "url_key", "left")
    last = F.coalesce("last_attempt_at", "captured_at")
    waited = F.unix_micros(now) - F.unix_micros(last)
    return joined.filter(last.isNull() | (waited >= minutes * 60_000_000))


def health(results: DataFrame, baselines: DataFrame, failures_cap: int = R.MAX_CONSECUTIVE_FAILURES) -> DataFrame:
    """State of checks per URL; results for another baseline are ignored.

    Results: (check_id, url_key, baseline_captured_at, checked_at, ok, category).  A URL checked very often is
    counted per day first, so the final step sees days, not checks.
    """
    live = baselines.select("url_key", F.col("captured_at").alias("baseline_captured_at"))
    mine = results.join(live, ["url_key", "baseline_captured_at"], "left_semi")
    order = F.struct("checked_at", "check_id")
    success = mine.groupBy("url_key").agg(F.max(F.when(F.col("ok"), order)).alias("last_success"), F.max_by(F.struct("checked_at", "ok", "category"), order).alias("last"))
    failures = mine.filter(~F.col("ok")).join(success.select("url_key", "last_success"), "url_key")
    later = F.col("last_success").isNull() | (order > F.col("last_success"))
    streak = failures.groupBy("url_key").agg(F.count_if(later).alias("failures"))
    allowed = F.when(F.col("last.category").isin(R.CHECK_ERRORS), F.col("last.category")).otherwise("unknown")
    return success.join(streak, "url_key", "left").select(
        "url_key",
        F.col("last.checked_at").alias("last_attempt_at"),
        F.col("last_success.checked_at").alias("last_success_at"),
        F.least(F.lit(failures_cap), F.coalesce("failures", F.lit(0))).alias("consecutive_failures"),
        F.when(F.col("last.ok"), "").otherwise(allowed).alias("error_category"),
    )


def run_summary(comparisons: DataFrame, told: DataFrame, run: str = "captured_at") -> DataFrame:
    """Per run: how many were checked, changed, notified and failed."""
    sent = told.select("url_key", "version", F.lit(1).alias("told"))
    joined = comparisons.join(sent, ["url_key", "version"], "left")
    good = F.col("status") == "analyzed"
    return joined.groupBy(run).agg(
        F.count("*").alias("checked"),
        F.count_if(good & F.col("changed")).alias("changed"),
        F.count_if(good & F.col("told").isNotNull()).alias("notified"),
        F.count_if(~good).alias("failed"),
    )
