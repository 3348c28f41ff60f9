"""Ordered scans over ranges, their streams, and the bucketed table: brute-force twins, nulls, ties, late and hot rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from clausetrail.operators import cookies as K
from clausetrail.operators import sequences as SQ
from clausetrail.streaming import jobs
from clausetrail.streaming import ordered as OR
from clausetrail.streaming import sessions as SE
from clausetrail.streaming.bucket_store import BUCKET, BucketStore
from clausetrail.streaming.rate_limit import sample, sample_stream

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "request_id bigint, tab_id bigint, ts timestamp, resource_type string, method string, explicit boolean, fingerprint string"


def at(seconds: float | None) -> dt.datetime | None:
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def rows_of(seed: int, n: int = 900, nulls: bool = True):
    """One tab has most events, within one hour; some have no tab, no time or no fingerprint."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        tab = pick.choice([1, 1, 1, 1, 1, 1, 1, 1, 2, 3, None if nulls else 4])
        seconds = pick.choice([pick.randrange(3600), pick.randrange(3600), pick.randrange(40_000)])
        seconds = None if nulls and pick.random() < 0.03 else seconds
        explicit = pick.random() < 0.1
        rows.append((i, tab, at(seconds), pick.choice(["main_frame", "x", "x", "x"]), "POST" if explicit else "GET", explicit, pick.choice(["a", "a", "b", None if nulls else "c"])))
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[2] is not None, r[2] or T0, r[0]))


class Model:
    """What happens to the events of each tab, one after the other."""

    def __init__(self):
        self.sessions, self.visits, self.last, self.held, self.prints = {}, {}, {}, {}, {}
        self.session_no, self.visit_no, self.effective, self.changed, self.previous = {}, {}, {}, {}, {}

    def see(self, rows):
        for i, tab, ts, kind, _, explicit, own in in_order(rows):
            self.sessions[tab] = self.sessions.get(tab, 0) + (kind == "main_frame")
            self.session_no[i] = self.sessions[tab]
            before = self.last.get(tab)
            known = before is not None and before[1] is not None and ts is not None
            opens = before is None or not known or (ts - before[1]).total_seconds() >= 3600
            self.visits[tab] = self.visits.get(tab, 0) + opens
            self.visit_no[i] = self.visits[tab]
            self.previous[i] = before and before[0]
            self.last[tab] = (i, ts)
            held = self.held.get(tab)
            if explicit or held is None or ts is None or (ts - held).total_seconds() >= 300:
                self.effective[i] = explicit
            if explicit and ts is not None and (held is None or ts > held):
                self.held[tab] = ts
            if tab not in self.prints or self.prints[tab] != own:
                self.changed[i] = tab
            self.prints[tab] = own


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("partitions", ["1", "4", "60"])
def test_scans_equal_one_walk_per_tab(spark, partitions):
    rows = rows_of(5)
    want = Model()
    want.see(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, rows)
        assert {r.request_id: r.session_no for r in SE.rotate(df).collect()} == want.session_no
        assert {r.request_id: r.visit_no for r in SE.with_inactivity(df).collect()} == want.visit_no
        got = SQ.with_previous(df, "tab_id", "ts", "request_id", F.struct(F.col("request_id").alias("r")))
        assert {r.request_id: r.previous and r.previous.r for r in got.collect()} == want.previous
        assert {r.request_id: r.explicit for r in SE.indicator_updates(df).collect()} == want.effective
        assert {r.request_id: r.tab_id for r in SE.changed_scans(df).collect()} == want.changed
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_unknown_fingerprints_are_equal(spark):
    rows = [(i, 1, at(i), "x", "GET", False, f) for i, f in enumerate([None, "a", "a", None, "b"], 1)]
    assert sorted(r.request_id for r in SE.changed_scans(frame(spark, rows)).collect()) == [1, 2, 4, 5]


def test_a_hot_hour_spans_many_tasks(spark):
    """Nine of ten events are one tab's, in one hour: no task has more than a small share of them."""
    events = spark.range(40_000).select(
        F.col("id").alias("request_id"), F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("tab_id"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.pmod(F.xxhash64("id"), F.lit(3_600_000_000))).alias("ts"), F.lit("x").alias("resource_type"),
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = SQ.arranged(events, "tab_id", "ts", "request_id")
        sizes = [r["count"] for r in ranged.groupBy("tab_id", SQ.RANGE).count().collect()]
        assert len(sizes) > 14 and max(sizes) < 5_000
        numbered = SE.with_inactivity(events)
        assert numbered.filter("visit_no <> 1").isEmpty() and numbered.count() == 40_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_visit_numbers_need_few_scans(spark):
    df = frame(spark, rows_of(2))
    plan = SE.with_inactivity(df)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("Exchange hashpartitioning") <= 4 and text.count("FileScan") <= 2


def test_sampling_keeps_events_without_tab_or_time(spark):
    rows = rows_of(8)
    got = {r.request_id: r for r in sample(frame(spark, rows), 2, 1 / 60).collect()}
    assert set(got) == {r[0] for r in rows} and all(got[r[0]].tab_id == r[1] for r in rows)
    assert not all(r.allowed for r in got.values())


def feed(spark, tmp_path, parts):
    """A folder that gets one file for each part, and a stream of it."""
    source = tmp_path / "in"
    source.mkdir()

    def put(n):
        parts[n].coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        (source / f"{n}.parquet").write_bytes(next((tmp_path / f"part{n}").glob("*.parquet")).read_bytes())
        return spark.readStream.schema(parts[n].schema).parquet(str(source))

    return put


def test_streams_go_on_from_batch_to_batch(spark, tmp_path):
    """Three triggers; later ones bring late events, which count where they arrive."""
    triggers = [rows_of(1, 300), [(1000 + r[0], *r[1:]) for r in rows_of(2, 300)], [(2000 + r[0], *r[1:]) for r in rows_of(3, 200)]]
    want = Model()
    jobs_ = {
        "rotate": (OR.rotate, lambda m: {(i, n) for i, n in m.session_no.items()}, "session_no"),
        "visits": (OR.number_visits, lambda m: {(i, n) for i, n in m.visit_no.items()}, "visit_no"),
        "updates": (OR.effective_updates, lambda m: set(m.effective.items()), "explicit"),
        "scans": (OR.changed_scans, lambda m: set(m.changed.items()), "tab_id"),
    }
    (tmp_path / "feed").mkdir()
    put = feed(spark, tmp_path / "feed", [frame(spark, x) for x in triggers])
    for n, rows in enumerate(triggers):
        stream = put(n)
        want.see(rows)
        for name, (job, told, column) in jobs_.items():
            job(stream, str(tmp_path / name / "out"), str(tmp_path / name / "progress"), buckets=3).awaitTermination()
            got = spark.read.parquet(str(tmp_path / name / "out"))
            assert {(r.request_id, r[column]) for r in got.collect()} == told(want), (name, n)


def bucket_model(triggers, capacity, per_second):
    """One token bucket per tab, request after request; late ones count as made when the tab was last seen."""
    buckets, allowed, seen = {}, {}, {}
    for rows in triggers:
        timed = [(r[0], r[1], max(r[2], seen.get(r[1], r[2])), r[3]) for r in rows]
        for i, tab, ts, kind in in_order(timed):
            seen[tab] = ts
            tokens, last = buckets.get(tab, (float(capacity), None))
            if kind == "main_frame":
                buckets[tab], allowed[i] = (float(capacity), None), True
                continue
            if last is not None:
                tokens = min(float(capacity), tokens + (ts - last).total_seconds() * per_second)
            allowed[i] = tokens >= 1
            buckets[tab] = (tokens - allowed[i], ts)
    return allowed


def test_rate_sampling_goes_on_from_batch_to_batch(spark, tmp_path):
    """Buckets are left part full between triggers; the batch form agrees where there is one trigger."""
    triggers = []
    for n in range(3):
        rows = rows_of(40 + n, 250, nulls=False)
        triggers.append([(1000 * n + r[0], r[1], r[2] + dt.timedelta(seconds=600 * n), "main_frame" if pick % 41 == 0 else "x", *r[4:]) for pick, r in enumerate(rows)])
    put = feed(spark, tmp_path, [frame(spark, x) for x in triggers])
    for n in range(3):
        sample_stream(put(n), str(tmp_path / "out"), str(tmp_path / "progress"), 3, 1 / 150, buckets=3).awaitTermination()
        want = bucket_model(triggers[: n + 1], 3, 1 / 150)
        got = {r.request_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == want and 0.1 < sum(want.values()) / len(want) < 0.9
    assert {r.request_id: r.allowed for r in sample(frame(spark, triggers[0]), 3, 1 / 150).collect()} == bucket_model(triggers[:1], 3, 1 / 150)


def test_a_batch_that_runs_again_gives_the_same(spark, tmp_path):
    """The progress of the second trigger is lost, as after a failure between its results and its commit."""
    triggers = [rows_of(1, 200), [(1000 + r[0], *r[1:]) for r in rows_of(2, 200)]]
    put = feed(spark, tmp_path, [frame(spark, x) for x in triggers])
    out, progress = tmp_path / "out", tmp_path / "progress"
    OR.rotate(put(0), str(out), str(progress), buckets=3).awaitTermination()
    stream = put(1)
    OR.rotate(stream, str(out), str(progress), buckets=3).awaitTermination()
    once = sorted(map(tuple, spark.read.parquet(str(out)).collect()))
    for name in ("1", ".1.crc"):
        (progress / "commits" / name).unlink(missing_ok=True)
    OR.rotate(stream, str(out), str(progress), buckets=3).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(out)).collect())) == once


def test_members_follow_the_stream_of_starts(spark, tmp_path):
    """A start cuts off what is older, also events that come late; a late start changes nothing."""
    event = lambda i, tab, s: (i, tab, at(s), "x", "GET", False, None)
    start = lambda i, tab, s: (i, tab, at(s), "main_frame", "GET", False, None)
    triggers = [
        [event(1, 1, 5), start(2, 1, 10), event(3, 1, 10), event(4, 1, 12), event(5, 2, 1), event(6, None, 3), start(7, None, 3)],
        [event(11, 1, 9), event(12, 1, 11), event(13, None, 2), event(14, None, 4)],
        [start(21, 1, 100), event(22, 1, 50), event(23, 1, 101), start(24, 1, 20), start(25, 2, 7), event(26, 2, 7)],
    ]
    put = feed(spark, tmp_path, [frame(spark, x) for x in triggers])
    want = set()
    for n, more in enumerate([{3, 4}, {12, 14}, {23, 26}]):
        stream = put(n)
        starts = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).filter("resource_type = 'main_frame'")
        OR.members(stream.filter("resource_type = 'x'"), starts, str(tmp_path / "out"), str(tmp_path / "progress"), buckets=2).awaitTermination()
        want |= more
        assert {r.request_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_stale_generations_are_rejected(spark, tmp_path):
    triggers = [rows_of(1, 200), [(1000 + r[0], *r[1:]) for r in rows_of(2, 200)]]
    put = feed(spark, tmp_path, [frame(spark, x) for x in triggers])
    model, want = Model(), set()
    for n, rows in enumerate(triggers):
        OR.current_generation(put(n), str(tmp_path / "out"), str(tmp_path / "progress"), buckets=2).awaitTermination()
        model.see(rows)
        want |= {(r[0], model.session_no[r[0]]) for r in rows if model.session_no[r[0]] == model.sessions[r[1]]}
        assert {(r.request_id, r.session_no) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


CHANGES = "change_id bigint, tab_id bigint, ts timestamp, name string, domain string, removed boolean, secure boolean, same_site string, partition_site string"


def cookie_changes(spark, seed, n, first=0, span=40_000):
    pick = random.Random(seed)
    rows = [
        (first + i, pick.choice([1, 1, 1, 2, 3]), at(pick.randrange(span)), f"pref{pick.choice('abcdef')}", pick.choice([".a.com", "b.org", "c.net"]), pick.random() < 0.3, True, "lax", pick.choice([None, "https://a.com"]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, CHANGES)


def test_cookie_state_stream_equals_the_batch_form(spark, tmp_path):
    parts = [K.with_identity(cookie_changes(spark, s, 150, 1000 * s)) for s in (1, 2, 3)]
    put = feed(spark, tmp_path, parts)
    whole = None
    for n, part in enumerate(parts):
        OR.cookie_state(put(n), str(tmp_path / "table"), str(tmp_path / "progress"), buckets=4).awaitTermination()
        whole = part if whole is None else whole.unionByName(part)
        got = OR.cookies_now(part, str(tmp_path / "table"))
        assert sorted(map(str, got.collect())) == sorted(map(str, K.reconcile(whole).collect()))
        capped = OR.cookies_now(part, str(tmp_path / "table"), cap=2)
        assert sorted(map(str, capped.collect())) == sorted(map(str, K.reconcile(whole, cap=2).collect()))


def test_tombstones_expire_and_the_state_stays_small(spark, tmp_path):
    """Each day sets and deletes its own cookies; the table holds one day of them, not all."""
    rows = lambda day: [(1000 * day + i, 1, at(86_400 * day + i), f"cookie{'abcdefghij'[day]}{'abcdefghij'[i % 10]}", ".a.com", i >= 10, True, "lax", "https://a.com") for i in range(20)]
    parts = [K.with_identity(spark.createDataFrame(rows(day), CHANGES)) for day in range(5)]
    put = feed(spark, tmp_path, parts)
    for n, part in enumerate(parts):
        OR.cookie_state(put(n), str(tmp_path / "table"), str(tmp_path / "progress"), keep_tombstones_seconds=90_000, buckets=1).awaitTermination()
        held = BucketStore(spark, str(tmp_path / "table"), K.fold_changes(part).schema, ["tab_id", "identity"]).read()
        assert held.count() <= 2 * K.fold_changes(part).count()


def test_fair_queue_stream_equals_the_batch_form(spark, tmp_path):
    parts = [cookie_changes(spark, s, 200, 1000 * s, 7_200).withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {s} HOURS")) for s in (1, 2, 3)]
    put = feed(spark, tmp_path, parts)
    seen = None
    for n, part in enumerate(parts):
        OR.fair_queue(put(n), str(tmp_path / "out"), str(tmp_path / "progress"), "30 minutes", 3_600, 4, 9, buckets=3).awaitTermination()
        # Changes for a batch that has closed before are dropped.
        if seen is not None:
            newest = seen.agg(F.max("ts")).first()[0]
            end = F.window("ts", "30 minutes")["end"]
            part = part.withColumn("late", end <= F.lit(newest) - F.expr("INTERVAL 1 HOUR")).filter("NOT late").drop("late")
        seen = part if seen is None else seen.unionByName(part)
        newest = seen.agg(F.max("ts")).first()[0]
        batches = seen.withColumn("w", F.window("ts", "30 minutes")).withColumn("batch_start", F.col("w.start"))
        done = batches.filter(F.col("w.end") <= F.lit(newest) - F.expr("INTERVAL 1 HOUR"))
        want = K.fair_queue(done.drop("w"), 4, 9).select("change_id", "batch_start", "turn", "place")
        got = spark.read.parquet(str(tmp_path / "out")).select("change_id", "batch_start", "turn", "place")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    store = BucketStore(spark, f"{tmp_path}/out-ring", spark.createDataFrame([], "batch_start timestamp, queue_domain string").schema, ["batch_start", "queue_domain"])
    per_ring = store.read().groupBy("batch_start", "queue_domain").count().agg(F.max("count")).first()[0]
    assert per_ring is None or per_ring <= 4


# -- the bucketed table ---------------------------------------------------------------------


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k bigint, v bigint")


def largest(saved, new):
    return saved.unionByName(new).groupBy("k").agg(F.max("v").alias("v"))


def contents(store):
    return {r.k: r.v for r in store.read().collect()}


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.glob("rows/**/*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    schema = keyed(spark, [(1, 1)]).schema
    store = BucketStore(spark, str(tmp_path), schema, ["k"], 16)
    store.update(keyed(spark, [(k, k) for k in range(400)]), 0, largest)
    before = files(tmp_path)
    store.update(keyed(spark, [(7, 1000)]), 1, largest)
    fresh = {f: t for f, t in files(tmp_path).items() if f not in before}
    assert len(fresh) == 1 and contents(store) == {k: 1000 if k == 7 else k for k in range(400)}
    store.update(keyed(spark, [(None, 5), (401, 1)]), 2, largest)
    assert contents(store) == {**{k: 1000 if k == 7 else k for k in range(400)}, None: 5, 401: 1}
    # The number of buckets is the table's, whatever a later reader thinks.
    assert contents(BucketStore(spark, str(tmp_path), schema, ["k"], 3)) == contents(store)


def test_replays_and_lost_writes(spark, tmp_path, monkeypatch):
    schema = keyed(spark, [(1, 1)]).schema
    store = BucketStore(spark, str(tmp_path), schema, ["k"], 4)
    store.update(keyed(spark, [(k, 0) for k in range(20)]), 0, largest)
    batch = keyed(spark, [(3, 9), (50, 1)])

    def lost(self, manifest):
        raise OSError("lost before the manifest")

    with monkeypatch.context() as m:
        m.setattr(BucketStore, "_publish", lost)
        with pytest.raises(OSError):
            store.update(batch, 1, largest)
    assert contents(store) == {k: 0 for k in range(20)}  # readers see the epoch before
    want = {**{k: 0 for k in range(20)}, 3: 9, 50: 1}
    for _ in range(2):
        store.update(batch, 1, largest)
        assert contents(store) == want
    # A merge that isn't idempotent also gives the same, as an epoch starts from the one before it.
    for _ in range(2):
        store.update(keyed(spark, [(3, 1)]), 2, lambda saved, new: saved.unionByName(new).groupBy("k").agg(F.sum("v").alias("v")))
        assert contents(store)[3] == 10


def test_old_files_go_and_empty_buckets_stay_readable(spark, tmp_path):
    schema = keyed(spark, [(1, 1)]).schema
    store = BucketStore(spark, str(tmp_path), schema, ["k"], 2)
    for epoch in range(6):
        store.update(keyed(spark, [(k, epoch) for k in range(20)]), epoch, largest)
    held = {p.name for p in (tmp_path / "rows").iterdir() if not p.name.startswith("_")}
    assert held == {"epoch=4", "epoch=5"} and len(store.epochs()) == 2
    store.update(keyed(spark, [(k, 0) for k in range(20)]), 6, lambda saved, new: saved.filter("false"))
    assert contents(store) == {} and BUCKET not in store.read().columns


def test_versions_are_upserted_by_bucket(spark, tmp_path):
    from clausetrail.operators import versions as V
    from clausetrail.plans.inputs import inputs

    versions = inputs(spark, "/root/testdata/sf0.001").versions.select("url_key", "version", "captured_at", "sections")
    put = feed(spark, tmp_path, [versions.filter(f"version = {n}") for n in range(3)])
    want = versions.limit(0)
    for n in range(3):
        jobs.upsert_versions(put(n), str(tmp_path / "table"), str(tmp_path / "progress"), buckets=8).awaitTermination()
        want = V.upsert(want, versions.filter(f"version = {n}"))
        key = lambda rows: sorted((r["url_key"], r["version"], r["captured_at"]) for r in rows)
        assert key(jobs.saved_versions(versions, str(tmp_path / "table")).collect()) == key(want.collect())
