"""Time, order and state: edges the tables do not reach, and brute-force twins."""

from __future__ import annotations

import datetime as dt
import html.parser
import random

from pyspark.sql import functions as F

from clausetrail.operators import consent as C
from clausetrail.operators import cookies as K
from clausetrail.operators import versions as V
from clausetrail.sources.html import extract_text, visible_text
from clausetrail.streaming import sessions as SE
from clausetrail.streaming.rate_limit import admit, sample

T0 = dt.datetime(2024, 1, 1)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def events(spark, rows):
    return spark.createDataFrame(rows, "request_id bigint, tab_id bigint, ts timestamp, resource_type string")


def test_buckets_around_the_choice(spark):
    rows = [(0, -1.001, "before"), (1, -1.0, "unknown"), (2, 1.0, "unknown"), (3, 1.001, "after"), (4, -200.0, "outside")]
    df = spark.createDataFrame([(i, at(100 + s)) for i, s, _ in rows], "i bigint, ts timestamp")
    got = df.select("i", C.bucket(F.col("ts"), F.lit(at(0)), F.lit(at(100))).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in got] == [b for _, _, b in rows]
    none = df.select(C.bucket(F.lit(None).cast("timestamp"), F.lit(at(0)), F.lit(at(100)))).first()[0]
    assert none == "unknown"


def test_requests_up_to_each_of_many_moments(spark):
    pick = random.Random(9)
    requests = [(i, pick.choice([1, 1, 1, 2, None]), at(pick.randrange(500)), "x") for i in range(300)]
    moments = sorted({(pick.choice([1, 2, None, 3]), at(pick.randrange(-10, 520))) for _ in range(40)}, key=str)
    got = C.request_counts_at(spark.createDataFrame(moments, "tab_id bigint, created_at timestamp"), events(spark, requests)).collect()
    want = {(tab, when): sum(r[1] == tab and r[2] <= when for r in requests) for tab, when in moments}
    assert {(r["tab_id"], r["created_at"]): r["request_count"] for r in got} == want


def test_a_gap_of_exactly_one_hour_ends_a_visit(spark):
    df = events(spark, [(1, 1, at(0), "x"), (2, 1, at(3600), "x"), (3, 1, at(7199.999), "x")])
    got = {r["request_id"]: r["visit_no"] for r in SE.with_inactivity(df).collect()}
    assert got == {1: 1, 2: 2, 3: 2}
    assert SE.visits(df).count() == 2


def test_rate_sampling_equals_one_bucket_per_tab(spark):
    rng = random.Random(3)
    times = {1: 0.0, 2: 0.0}
    rows = []
    for i in range(800):
        tab = 1 if rng.random() < 0.9 else 2
        times[tab] += rng.choice([0.01, 0.05, 0.2, 3.0])
        rows.append((i, tab, at(times[tab]), "main_frame" if rng.random() < 0.01 else "xmlhttprequest"))
    want, buckets = {}, {}
    for i, tab, ts, kind in sorted(rows, key=lambda r: (r[2], r[0])):
        if kind == "main_frame":
            buckets.pop(tab, None)
            want[i] = True
            continue
        tokens, last = buckets.get(tab, (3.0, ts))
        tokens = min(3.0, tokens + (ts - last).total_seconds() * 2)
        want[i] = tokens >= 1
        buckets[tab] = (tokens - want[i], ts)
    got = {r["request_id"]: r["allowed"] for r in sample(events(spark, rows), 3, 2).collect()}
    assert got == want and not all(want.values())


def test_bucket_walk():
    import numpy as np

    allowed, tokens, _ = admit(np.array([0, 0, 0, 0, 500_000]), 3.0, None, 3, 2)
    assert allowed.tolist() == [True, True, True, False, True] and tokens == 0


def test_explicit_analysis_holds_five_minutes(spark):
    rows = [(1, 1, at(0), True, "high"), (2, 1, at(299), False, "low"), (3, 1, at(300), False, "low"), (4, 1, at(4000), False, "low")]
    df = spark.createDataFrame(rows, "request_id bigint, tab_id bigint, ts timestamp, explicit boolean, level string")
    assert {r["request_id"] for r in SE.indicator_updates(df).collect()} == {1, 3, 4}


def cookie_rows(spark, rows):
    schema = "change_id bigint, tab_id bigint, ts timestamp, name string, domain string, removed boolean, secure boolean, same_site string, partition_site string"
    return K.with_identity(spark.createDataFrame([(i, 1, at(s), n, ".a.com", gone, True, "lax", p) for i, s, n, gone, p in rows], schema))


def test_cookie_state_evidence(spark):
    site = "https://a.com"
    rows = [
        (1, 0, "_ga", True, site),  # a delete alone is no evidence
        (2, 1, "_gid", False, site),
        (3, 2, "_gid", True, site),  # leaves a tombstone
        (4, 3, "cart", False, None),
        (5, 4, "cart", True, None),  # unpartitioned: gone
        (6, 5, "lang", True, site),
        (7, 6, "lang", False, site),  # the early delete is forgotten
    ]
    got = {r["name"]: r for r in K.reconcile(cookie_rows(spark, rows)).collect()}
    assert set(got) == {"_gid", "lang"}
    assert got["_gid"]["removed"] and got["_gid"]["deleted_at"] == at(2) and got["_gid"]["last_set_at"] == at(1)
    assert got["lang"]["deleted_at"] is None


def test_live_cookies_outlast_tombstones_under_the_cap(spark):
    site = "https://a.com"
    rows = [(1, 0, "cart", False, site), (2, 10, "_gid", False, site), (3, 11, "_gid", True, site)]
    assert [r["name"] for r in K.reconcile(cookie_rows(spark, rows), cap=1).collect()] == ["cart"]


def test_fair_queue_takes_turns(spark):
    rows = [(i, at(i), "big.com") for i in range(20)] + [(100 + i, at(i), f"s{i}.com") for i in range(3)]
    df = spark.createDataFrame(rows, "change_id bigint, ts timestamp, domain string").withColumn("batch_start", F.lit(T0))
    kept = [r["domain"] for r in K.fair_queue(df, per_domain=5, total=6).collect()]
    assert sorted(kept) == ["big.com"] * 3 + ["s0.com", "s1.com", "s2.com"]


def test_first_instant_reads_numbers_and_dates(spark):
    df = spark.createDataFrame([("", "1704067200000", "x"), (None, "-5", "2024-01-01T00:00:00Z")], "a string, b string, c string")
    got = [r[0] for r in df.select(C.first_instant(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [T0, T0]


def test_section_added_only_without_a_row_before(spark):
    schema = f"url_key string, version bigint, captured_at timestamp, text_hash string, status string, risk_ids array<string>, sections {V.SECTION}"
    row = lambda id, found, text: (id, found, text, text)
    old = ("u", 0, at(0), "h0", "analyzed", ["a"], [row("security", False, ""), row("retention", True, "not shared")])
    new = ("u", 1, at(10), "h1", "analyzed", ["b"], [row("security", True, "x"), row("retention", True, "y"), row("purpose", True, "z")])
    got = V.compare(spark.createDataFrame([old, new], schema)).collect()
    assert len(got) == 1
    assert {(c["id"], c["change_type"]) for c in got[0]["section_changes"]} == {("retention", "modified"), ("purpose", "added")}
    assert got[0]["added_risks"] == ["b"] and got[0]["removed_risks"] == ["a"]


def test_prune_skips_what_does_not_fit(spark):
    rows = [("t", "a", at(4), 50), ("t", "b", at(3), 60), ("t", "c", at(2), 40), ("t", "d", at(1), 500)]
    df = spark.createDataFrame(rows, "tenant string, url_key string, captured_at timestamp, bytes bigint")
    assert sorted(r["url_key"] for r in V.prune(df, 50, 100).collect()) == ["a", "c"]
    assert [r["url_key"] for r in V.prune(df, 1, 100).collect()] == ["a"]


class _Plain(html.parser.HTMLParser):
    """Text of article outside hidden parts, for well-formed markup only."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        self.out.append(" ")
        if tag in ("br", "img", "meta"):
            return
        style = dict(attrs).get("style", "") or ""
        hidden = tag in ("script", "style") or "hidden" in dict(attrs) or "display: none" in style
        self.stack.append((tag, hidden))

    def handle_endtag(self, tag):
        self.out.append(" ")
        while self.stack and self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(h for _, h in self.stack):
            self.out.append(data)


def test_visible_text_against_a_plain_parser(spark):
    rng = random.Random(1)

    def node(depth):
        kind = rng.choice(["p", "div", "div hidden", 'div style="display: none"', "script", "b"])
        body = "".join(node(depth - 1) for _ in range(rng.randrange(3))) if depth and kind != "script" else ""
        return f"<{kind}>w{rng.randrange(99)} &amp; {body}</{kind.split()[0]}>"

    pages = ["<html><body>out<article>start " + "".join(node(3) for _ in range(4)) + "</article></body></html>" for _ in range(40)]
    got = extract_text(spark.createDataFrame(list(enumerate(pages)), "fetch_id int, body string")).orderBy("fetch_id").collect()
    for page, row in zip(pages, got, strict=True):
        plain = _Plain()
        plain.feed(page)
        assert row["text"] == " ".join("".join(plain.out).split())


def test_visible_text_edges():
    assert visible_text("<div hidden/>x</div>y") == "y"
    assert visible_text("<main>a</main><article>longer</article>") == "longer"
    assert visible_text('a<b title="1>2">c</b>&#x41;&bogus;&nbsp;d') == "a c A&bogus; d"
    assert visible_text("a<!-- never closed b") == "a"
    assert visible_text('x <p title="') == 'x <p title="'
    assert visible_text("<" * 50_000 + "'" + "<" * 50_000).startswith("<")
    assert visible_text("<div>" * 300 + "<p hidden>secret") == ""


def test_report_json_holds_no_details(spark):
    import json

    import __spark_entry__ as entry

    rows = entry.queries()["snk_1_report_records"](spark, "/root/testdata/sf0.001").collect()
    record = json.loads(rows[0]["record"])
    assert set(record["analysis"]) == {"policy", "network", "form", "storage", "consent", "delta", "jurisdiction", "alignment"}
    assert all("detail" not in f for part in record["analysis"].values() for f in part.get("findings", []))


def test_window_and_state_streams_run(spark, tmp_path):
    from clausetrail.sources.sample_views import load_stream
    from clausetrail.streaming import jobs

    sf = "/root/testdata/sf0.001"
    streams = {
        "visits": (jobs.visits(load_stream(spark, sf, "fx_requests")), "complete"),
        "batches": (jobs.cookie_batches(load_stream(spark, sf, "fx_cookie_changes"), "1 day"), "complete"),
        "state": (jobs.cookie_state(load_stream(spark, sf, "fx_cookie_changes")), "update"),
    }
    for name, (stream, mode) in streams.items():
        writer = stream.writeStream.format("noop").outputMode(mode).option("checkpointLocation", str(tmp_path / name))
        running = writer.trigger(availableNow=True).start()
        assert running.awaitTermination(90)
        assert running.lastProgress["numInputRows"] == 1000
        assert running.lastProgress["stateOperators"][0]["numRowsTotal"] > 0


def test_keys_are_sent_once_within_the_watermark_and_never_again(spark, tmp_path):
    from clausetrail.operators import versions as V
    from clausetrail.plans.inputs import inputs
    from clausetrail.streaming import jobs

    changes = inputs(spark, "/root/testdata/sf0.001").comparisons
    keyed = V.with_dedupe_key(changes)
    if "ts" not in changes.columns:
        changes = changes.withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    doubled = changes.unionByName(changes)
    doubled.write.parquet(str(tmp_path / "in"))
    sent = keyed.select("dedupe_key").distinct().orderBy("dedupe_key").limit(3)
    stream = spark.readStream.schema(doubled.schema).parquet(str(tmp_path / "in"))
    jobs.to_files(jobs.once_per_key(stream, sent, "ts").select("dedupe_key"), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    got = [r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    every = {r[0] for r in keyed.select("dedupe_key").collect()}
    assert len(got) == len(set(got)) and set(got) == every - {r[0] for r in sent.collect()}
