"""Sessions of a tab: rotation, inactivity, membership, the last events, the risk indicator.

Batch forms are exact and skew-safe (see ``operators.sequences``); ``streaming.ordered`` runs the same scans over
streams.  Events without a tab are one tab of their own, events without a time come first in theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.operators.cookies import with_tabs
from clausetrail.operators.sequences import Scan, previous, running_count, running_max_before, scanned, segments

# One microsecond short of an hour: a gap of exactly one hour closes the session.
SESSION_GAP = "59 minutes 59.999999 seconds"


def rotation() -> Scan:
    """``session_no``: every top-level document starts a new session of its tab (0 before the first)."""
    return running_count(F.col("resource_type") == "main_frame", "session_no")


def rotate(events: DataFrame) -> DataFrame:
    """Adds ``session_no``."""
    return scanned(events, "tab_id", "ts", "request_id", rotation())[0]


def visiting(ttl_seconds: int = R.SESSION_TTL_SECONDS) -> Scan:
    """``visit_no``: a gap of the ttl or more starts a new visit."""
    return segments("ts", ttl_seconds * 1_000_000, "visit_no")


def with_inactivity(events: DataFrame, ttl_seconds: int = R.SESSION_TTL_SECONDS) -> DataFrame:
    """Adds ``visit_no``."""
    return scanned(events, "tab_id", "ts", "request_id", visiting(ttl_seconds))[0]


def visits(events: DataFrame) -> DataFrame:
    """Session windows per tab: works on a batch and on a stream with a watermark."""
    window = F.session_window("ts", SESSION_GAP)
    return events.groupBy("tab_id", window.alias("w")).agg(F.count("*").alias("events")).select(
        "tab_id", F.col("w.start").alias("started_at"), "events"
    )


def sessions(rotated: DataFrame) -> DataFrame:
    """One row per session: start, last event and origin of its top-level document."""
    order = F.struct("ts", "request_id")
    return rotated.groupBy("tab_id", "session_no").agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_seen_at"),
        F.count("*").alias("events"),
        F.min_by("host", order).alias("first_host"),
    )


def _same_tab(events: DataFrame, tabs: DataFrame) -> Column:
    return events["tab_id"].eqNullSafe(tabs["own_tab"])


def after_start(started: Column, started_id: Column) -> Column:
    """Whether an event isn't older than a session start; a null time is older than any other."""
    later = (F.col("ts") > started) | (started.isNull() & F.col("ts").isNotNull())
    return later | (F.col("ts").eqNullSafe(started) & (F.col("request_id") >= started_id))


def in_session(events: DataFrame, starts: DataFrame) -> DataFrame:
    """Events not older than the current session of their tab.  ``starts``: (tab_id, started_at, started_id)."""
    named = starts.withColumnRenamed("tab_id", "own_tab")
    joined = events.join(named, _same_tab(events, named))
    return joined.filter(after_start(F.col("started_at"), F.col("started_id"))).drop("started_at", "started_id", "own_tab")


def current_sessions(rotated: DataFrame) -> DataFrame:
    """Start of the newest session of each tab."""
    order = F.struct("ts", "request_id")
    top = rotated.groupBy("tab_id", "session_no").agg(F.min(order).alias("start"))
    newest = top.groupBy("tab_id").agg(F.max_by("start", "session_no").alias("start"))
    return newest.select("tab_id", F.col("start.ts").alias("started_at"), F.col("start.request_id").alias("started_id"))


def drop_stale(rotated: DataFrame) -> DataFrame:
    """Events of the current session of each tab; older generations are rejected."""
    current = rotated.groupBy(F.col("tab_id").alias("own_tab")).agg(F.max("session_no").alias("current_no"))
    return rotated.join(current, _same_tab(rotated, current) & (rotated["session_no"] == current["current_no"]), "left_semi")


def last_events(events: DataFrame, n: int = R.REQUESTS_PER_TAB) -> DataFrame:
    """The newest ``n`` events of each tab; Spark cuts to ``n`` before and after the shuffle."""
    newest = Window.partitionBy("tab_id").orderBy(F.desc("ts"), F.desc("request_id"))
    return events.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n)


def recent_tabs(events: DataFrame, n: int = R.OBSERVED_TABS) -> DataFrame:
    """The ``n`` tabs seen last: a top-k, never a sort of everything."""
    seen = events.groupBy("tab_id").agg(F.max("ts").alias("last_seen_at"))
    return seen.orderBy(F.desc("last_seen_at"), F.desc("tab_id")).limit(n)


def holding(hold_seconds: int = R.EXPLICIT_PRIORITY_SECONDS) -> Scan:
    """``takes_effect``: an automatic scan is ignored while an explicit analysis is fresh."""
    scan = running_max_before(F.when(F.col("explicit"), F.col("ts")), "held")
    held = scan.result["held"]
    fresh = F.unix_micros("ts") - F.unix_micros(held) < hold_seconds * 1_000_000
    return Scan(scan.local, scan.carried, scan.state, {"takes_effect": F.col("explicit") | ~F.coalesce(fresh, F.lit(False))})


def indicator_updates(updates: DataFrame, hold_seconds: int = R.EXPLICIT_PRIORITY_SECONDS) -> DataFrame:
    """Updates that take effect.  Updates: (tab_id, ts, request_id, explicit, level)."""
    judged = scanned(updates, "tab_id", "ts", "request_id", holding(hold_seconds))[0]
    return judged.filter("takes_effect").drop("takes_effect")


def indicators(updates: DataFrame) -> DataFrame:
    """Current indicator per tab."""
    kept = indicator_updates(updates)
    last = kept.groupBy("tab_id").agg(F.max_by(F.struct("ts", "level", "explicit"), F.struct("ts", "request_id")).alias("l"))
    return last.select("tab_id", "l.*")


def changing(fingerprint: str = "fingerprint") -> Scan:
    """``changed``: the text differs from that of the scan before in the same tab; two unknown texts are equal."""
    scan = previous(F.struct(F.col(fingerprint).alias("f")))
    before = scan.result["previous"]
    return Scan(scan.local, scan.carried, scan.state, {"changed": before.isNull() | ~before["f"].eqNullSafe(F.col(fingerprint))})


def changed_scans(scans: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Scans whose text differs from the scan before in the same tab."""
    judged = scanned(scans, "tab_id", "ts", "request_id", changing(fingerprint))[0]
    return judged.filter("changed").drop("changed")


def paused_out(attributed: DataFrame, members: DataFrame, tabs: DataFrame, excluded: DataFrame) -> DataFrame:
    """(change_id, tab_id) of attributed cookie changes in tabs that are not excluded.

    Exclusion comes after attribution: leaving a tab out must not make an ambiguous cookie look unique.
    ``members`` is ``operators.cookies.site_tabs``; excluded tabs leave it before deletes are given their tabs.
    """
    out = tabs.join(excluded, "origin", "left_semi").select("tab_id")
    sets = attributed.filter("site IS NULL").join(out, "tab_id", "left_anti")
    deletes = attributed.filter("site IS NOT NULL")
    return with_tabs(sets.unionByName(deletes.select(*sets.columns)), members.join(out, "tab_id", "left_anti"))
