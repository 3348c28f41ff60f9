"""Ordered scans and keyed state over streams, batch by batch.

Each micro-batch goes through the same scan as a batch table (``operators.sequences``), so a tab with a third of
all events is spread over ranges here too and nothing of a tab is held by one worker.  What a tab carries on is one row in
a bucketed table (``bucket_store``) that stands ahead of the batch's rows.  Only the buckets of the batch's tabs are read
and rewritten.

A batch that runs again, after a failure, reads the state before it and writes the same files over.

Late events: no watermark is used, and none is dropped.  An event counts where it arrives, after those of earlier batches,
also when its time is before theirs; decisions already given out are not taken back.  State stays until ``idle`` seconds
before the newest event time of the batch that touches its bucket, or for good where ``idle`` is None.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausetrail import rules as R
from clausetrail.operators import cookies as K
from clausetrail.operators.sequences import Scan, arranged, scanned
from clausetrail.plans.stages import stage
from clausetrail.streaming import sessions as SE
from clausetrail.streaming.batches import each_batch
from clausetrail.streaming.bucket_store import BucketStore

IDLE_SECONDS = 30 * 86_400
BUCKETS = 64


def scan_stream(
    stream: DataFrame, path: str, checkpoint: str, scan: Callable[[], Scan], shown: Callable[[DataFrame], DataFrame], idle_seconds: int | None = IDLE_SECONDS, buckets: int = BUCKETS
) -> StreamingQuery:
    """The result of a scan along each tab's events; ``shown`` picks rows and columns of it."""

    def work(batch: DataFrame, epoch: int) -> DataFrame | None:
        rows = arranged(batch, "tab_id", "ts", "request_id")
        if rows.isEmpty():
            return None
        newest = rows.agg(F.max("ts").alias("newest")).first()["newest"]
        plan = scan()
        empty = scanned(rows.limit(0), "tab_id", "ts", "request_id", plan)[1]
        schema = empty.withColumn("_seen", F.lit(None).cast("timestamp")).schema
        store = BucketStore(batch.sparkSession, f"{path}-state", schema, ["tab_id"], buckets)
        made: list[DataFrame] = []

        def merge(saved: DataFrame, touched: DataFrame) -> DataFrame:
            result, state = scanned(rows, "tab_id", "ts", "request_id", plan, saved.drop("_seen"))
            made.append(result)
            times = saved.select("tab_id", "_seen").unionByName(rows.select("tab_id", F.col("ts").alias("_seen")))
            seen = times.groupBy(F.col("tab_id").alias("own_tab")).agg(F.max("_seen").alias("_seen"))
            kept = state.join(seen, state["tab_id"].eqNullSafe(seen["own_tab"])).drop("own_tab")
            if idle_seconds is None or newest is None:
                return kept
            # A tab of this batch stays, however late its events are.
            fresh = F.col("_seen") >= F.lit(newest) - F.expr(f"INTERVAL {idle_seconds} SECONDS")
            return kept.filter(fresh | F.col("_seen").isNull())

        # The result is read off the state before this batch; the store keeps that until the next one.
        store.update(rows.select("tab_id"), epoch, merge)
        return shown(made[0])

    return each_batch(stream, path, checkpoint, work)


def rotate(requests: DataFrame, path: str, checkpoint: str, **options: int) -> StreamingQuery:
    """request_id, tab_id, session_no."""
    return scan_stream(requests, path, checkpoint, SE.rotation, lambda r: r.select("request_id", "tab_id", "session_no"), **options)


def number_visits(requests: DataFrame, path: str, checkpoint: str, ttl_seconds: int = R.SESSION_TTL_SECONDS, **options: int) -> StreamingQuery:
    """request_id, tab_id, visit_no."""
    return scan_stream(requests, path, checkpoint, lambda: SE.visiting(ttl_seconds), lambda r: r.select("request_id", "tab_id", "visit_no"), **options)


def effective_updates(updates: DataFrame, path: str, checkpoint: str, hold_seconds: int = R.EXPLICIT_PRIORITY_SECONDS, **options: int) -> StreamingQuery:
    """request_id, tab_id, explicit of the updates that take effect."""
    return scan_stream(
        updates, path, checkpoint, lambda: SE.holding(hold_seconds), lambda r: r.filter("takes_effect").select("request_id", "tab_id", "explicit"), **options
    )


def changed_scans(scans: DataFrame, path: str, checkpoint: str, **options: int) -> StreamingQuery:
    """request_id, tab_id of the scans whose fingerprint differs from the one before."""
    return scan_stream(scans, path, checkpoint, SE.changing, lambda r: r.filter("changed").select("request_id", "tab_id"), **options)


# -- session membership: events against the newest session start --------------------------


def _with_starts(saved: DataFrame, starts: DataFrame) -> DataFrame:
    """The newest start of each tab, of those saved and those that came."""
    both = saved.unionByName(starts.select("tab_id", F.col("ts").alias("started_at"), F.col("request_id").alias("started_id")))
    newest = both.groupBy("tab_id").agg(F.max(F.struct("started_at", "started_id")).alias("start"))
    return newest.select("tab_id", "start.*")


def members(events: DataFrame, starts: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """request_id, tab_id of the events that aren't older than their tab's session.

    ``starts``: a second stream (tab_id, ts, request_id) of top-level documents; it changes the session of a tab.  Starts of a
    batch count before its events, as the reader sees them together.  An event of a tab without a known start
    belongs to no session.  A late start, older than the one known, changes nothing; a late event, older than
    the start, is rejected.
    """
    columns = ["tab_id", "ts", "request_id"]
    both = events.select(*columns, F.lit(False).alias("_start")).unionByName(starts.select(*columns, F.lit(True).alias("_start")))

    def work(batch: DataFrame, epoch: int) -> DataFrame | None:
        rows = stage(batch, "members")
        if rows.isEmpty():
            return None
        fresh = rows.filter("_start")
        schema = fresh.select("tab_id", F.col("ts").alias("started_at"), F.col("request_id").alias("started_id")).schema
        store = BucketStore(batch.sparkSession, f"{path}-state", schema, ["tab_id"], buckets)
        if not fresh.isEmpty():
            store.update(fresh, epoch, _with_starts)
        known = store.as_of(epoch)
        return SE.in_session(rows.filter("NOT _start"), known).select("request_id", "tab_id")

    return each_batch(both, path, checkpoint, work)


def current_generation(requests: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """request_id, tab_id, session_no of the events of a tab's newest session as of their batch; older ones are rejected."""

    def newest(result: DataFrame) -> DataFrame:
        return SE.drop_stale(stage(result.select("request_id", "tab_id", "session_no"), "generations"))

    return scan_stream(requests, path, checkpoint, SE.rotation, newest, buckets=buckets)


# -- cookies ------------------------------------------------------------------------------


def cookie_state(changes: DataFrame, path: str, checkpoint: str, keep_tombstones_seconds: int | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Folds cookie changes into a bucketed table of cookie states at ``path``; read it with ``cookies_now``.

    One row per tab and cookie.  A deleted cookie's row goes once its delete is ``keep_tombstones_seconds`` before the newest
    change time of a batch that touches its bucket, so the table is bounded by live cookies and recent deletes.
    """
    def work(batch: DataFrame, epoch: int) -> None:
        rows = stage(batch, "cookie_changes")
        if rows.isEmpty():
            return
        newest = rows.agg(F.max("ts").alias("newest")).first()["newest"]
        folded = K.fold_changes(rows)

        def merge(saved: DataFrame, _: DataFrame) -> DataFrame:
            both = K.merge_states(saved.unionByName(folded))
            if keep_tombstones_seconds is None or newest is None:
                return both
            late = F.col("last_change.ts") < F.lit(newest) - F.expr(f"INTERVAL {keep_tombstones_seconds} SECONDS")
            return both.filter(~(F.col("last.removed") & late))

        BucketStore(batch.sparkSession, path, folded.schema, ["tab_id", "identity"], buckets).update(folded, epoch, merge)

    return each_batch(changes, path, checkpoint, work)


def cookies_now(changes: DataFrame, path: str, cap: int | None = None) -> DataFrame:
    """Current cookies and safe tombstones from the table that ``cookie_state`` keeps; ``changes`` gives the columns."""
    schema = K.fold_changes(changes.limit(0)).schema
    return K.current_cookies(BucketStore(changes.sparkSession, path, schema, ["tab_id", "identity"]).read(), cap)


def _with_pages(saved: DataFrame, opened: DataFrame) -> DataFrame:
    """The newest address of each tab."""
    both = saved.unionByName(opened.select(*saved.columns))
    newest = both.groupBy("tab_id").agg(F.max_by(F.struct("ts", "request_id", "url"), F.struct("ts", "request_id")).alias("page"))
    return newest.select("tab_id", "page.*")


def attribution(changes: DataFrame, opened: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """change_id, tab_id, site of cookie changes, against a table of tabs that a second stream changes.

    ``opened``: (tab_id, ts, request_id, url) of top-level documents; a tab is at the newest of these.  A batch's changes meet
    the version of the table that its own documents have led to.  Deletes are one row with their site; the tabs
    that a site has at that version are written apart, below ``{path}-members``, once for each site of a batch.
    """
    change = F.struct("change_id", "removed", "domain", "partition")
    page = F.struct("tab_id", "ts", "request_id", "url")
    none = lambda like, kind: F.lit(None).cast(like.select(kind.alias("x")).schema["x"].dataType)
    both = changes.select(change.alias("change"), none(opened, page).alias("page")).unionByName(
        opened.select(none(changes, change).alias("change"), page.alias("page"))
    )

    def work(batch: DataFrame, epoch: int) -> DataFrame | None:
        rows = stage(batch, "attribution")
        if rows.isEmpty():
            return None
        fresh = rows.filter("page IS NOT NULL").select("page.*")
        store = BucketStore(batch.sparkSession, f"{path}-tabs", fresh.schema, ["tab_id"], buckets)
        if not fresh.isEmpty():
            store.update(fresh, epoch, _with_pages)
        tabs = store.as_of(epoch).select("tab_id", "url")
        own = rows.filter("change IS NOT NULL").select("change.*")
        K.site_tabs(own, tabs).write.mode("overwrite").parquet(f"{path}-members/epoch={epoch}")
        return K.attribute(own, tabs)

    return each_batch(both, path, checkpoint, work)


def fair_queue(
    changes: DataFrame, path: str, checkpoint: str, width: str, lateness_seconds: int, per_domain: int = R.QUEUE_PER_DOMAIN, total: int = R.QUEUE_TOTAL, buckets: int = BUCKETS
) -> StreamingQuery:
    """Waiting changes of open time batches: a ring of the newest ``per_domain`` for each batch and domain.

    A time batch closes when the newest change seen is ``lateness_seconds`` past its end: its ring goes out in turns, as
    ``operators.cookies.fair_queue`` gives them, and leaves the table.  Changes that come for a closed batch are dropped.  The
    table holds open batches only, at most ``per_domain`` rows for each of their domains.
    """
    windowed = changes.select("change_id", "ts", "domain", F.window("ts", width).alias("w")).select("change_id", "ts", "domain", F.col("w.start").alias("batch_start"), F.col("w.end").alias("batch_end"))

    def work(batch: DataFrame, epoch: int) -> DataFrame | None:
        rows = stage(batch.withColumn("queue_domain", K.bare_domain(F.col("domain"))), "queued")
        if rows.isEmpty():
            return None
        spark = batch.sparkSession
        clock = BucketStore(spark, f"{path}-clock", rows.select(F.lit(0).alias("one"), F.col("ts").alias("newest")).schema, ["one"], 1)
        tick = rows.agg(F.max("ts").alias("newest")).select(F.lit(0).alias("one"), "newest")
        before = clock.as_of(epoch - 1).agg(F.max("newest")).first()[0]
        clock.update(tick, epoch, lambda saved, new: saved.unionByName(new).groupBy("one").agg(F.max("newest").alias("newest")))
        now = clock.as_of(epoch).first()["newest"]

        def closed(at: object) -> Column:
            return F.lit(False) if at is None else F.col("batch_end") <= F.lit(at) - F.expr(f"INTERVAL {lateness_seconds} SECONDS")

        fresh = rows.filter(~closed(before))
        keys = ["batch_start", "queue_domain"]
        store = BucketStore(spark, f"{path}-ring", rows.schema, keys, buckets)
        waiting = store.as_of(epoch - 1)
        ring = K.newest_of_domain(waiting.unionByName(fresh), per_domain, "batch_start").drop("turn")
        done = stage(ring.filter(closed(now)), "closed")
        store.update(
            fresh.select(*keys).unionByName(done.select(*keys)),
            epoch,
            lambda saved, _: K.newest_of_domain(saved.unionByName(fresh), per_domain, "batch_start").filter(~closed(now)),
        )
        return K.fair_queue(done, per_domain, total).select("change_id", "batch_start", "turn", "place")

    return each_batch(windowed, path, checkpoint, work)
