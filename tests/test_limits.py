"""Nothing is cut by default: long texts, many cookies, fields, keys and rules; pages without a policy."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clausetrail.functions import urls as U
from clausetrail.operators import consent as C
from clausetrail.operators import cookies as K
from clausetrail.operators import forms_storage as FS
from clausetrail.operators import hosts as H
from clausetrail.operators import network as N
from clausetrail.operators import policy as P
from clausetrail.operators import requests as RQ
from clausetrail.operators import sections as S
from clausetrail.operators import vendors as V
from clausetrail.plans.inputs import inputs
from clausetrail.sources.html import visible_text


def test_what_comes_last_in_a_long_policy_is_found(spark):
    filler = "\n\n".join(f"Chapter {chr(65 + i % 26)}\nThe harbour keeps its lights on and boat {i} comes home with the tide." for i in range(4000))
    body = f"Privacy Policy. We collect your email address.\n\n{filler}\n\nSecurity\nWe protect your data with encryption and access controls.\n\nWe may sell personal information to business partners."
    assert len(body) > 300_000
    rows = spark.createDataFrame([(1, body)], "doc_id bigint, body string")
    risks = P.analyze(rows).select(F.transform("risks", lambda r: r["id"])).first()[0]
    assert "broad_data_sharing" in risks
    assert S.presence(rows).first()["security"]


def _changes(spark, n, tab=1):
    rows = [(i, tab, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", f"pref{'abcdefghij'[i % 10]}{i}", "shop.example", False, True, "lax", "") for i in range(n)]
    frame = spark.createDataFrame(rows, "change_id bigint, tab_id bigint, ts string, name string, domain string, removed boolean, secure boolean, same_site string, partition_site string")
    return K.with_identity(frame.withColumn("ts", F.to_timestamp("ts")))


def test_all_cookies_stay_and_the_delta_counts_them(spark):
    changes = _changes(spark, 500)
    cookies = K.reconcile(changes)
    assert cookies.count() == 500 and K.reconcile(changes, cap=120).count() == 120
    few = _changes(spark, 200)
    requests = spark.createDataFrame([(1, 1, "https://shop.example/", "shop.example", "/", "GET")], "request_id bigint, tab_id bigint, url string, host string, path string, method string").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    times = few.filter("change_id = 149").select("tab_id", F.col("ts").alias("created_at"))
    lines = spark.createDataFrame([], "tab_id bigint, observed_from timestamp, boundary_at timestamp")
    counts = C.request_counts(requests, lines, times)
    delta = C.delta(C.baselines_at(times, counts, few), counts, K.reconcile(few)).first()
    assert delta["cookie_delta"] == 50


def test_all_form_fields_count(spark):
    rows = [(i, 1, f"email{i}", "text", "", i % 2 == 0) for i in range(400)]
    fields = spark.createDataFrame(rows, "field_id bigint, tab_id bigint, name string, type string, label string, required boolean")
    pages = spark.createDataFrame([(1, [])], "tab_id bigint, disclosed array<string>")
    row = FS.analyze_forms(FS.classify_fields(FS.answer_fields(fields)), pages).first()
    assert row["field_count"] == 400 and [len(c["names"]) for c in row["categories"]] == [5] * len(row["categories"])


def test_all_query_keys_and_long_urls_stay(spark):
    keys = sorted(U._VOCABULARY)[:60]
    urls = ["https://a.example/p?" + "&".join(f"{k}=1" for k in keys), "https://a.example/p?page=" + "x" * 40_000]
    frame = spark.createDataFrame([(i, 1, u, "GET", "xhr") for i, u in enumerate(urls)], "request_id bigint, tab_id bigint, url string, method string, resource_type string")
    rows = RQ.minimise(frame.withColumn("ts", F.current_timestamp())).orderBy("request_id").collect()
    assert len(rows) == 2 and len(rows[0]["query_keys"]) == 60


def test_all_user_rules_count_and_ties_go_by_id(spark):
    rows = [(f"r{i:03d}", f"Vendor {i}", [f"v{i}.example"] + [f"x{j}.v{i}.example" for j in range(30)], "analytics", "high", ["third_party"], 1 if i < 5 else 2_000_000) for i in range(300)]
    rows += [("z", "Late", ["v1.example"], "analytics", "high", ["third_party"], 1), ("a", "Early", ["v2.example"], "analytics", "high", ["third_party"], 1)]
    frame = spark.createDataFrame(rows, "id string, vendor string, patterns array<string>, category string, risk string, expected_sections array<string>, position bigint")
    cleaned = V.clean_custom_rules(frame)
    assert cleaned.count() == 302 and cleaned.filter("size(patterns) = 31").count() == 300
    targets = spark.createDataFrame([("v1.example", "/"), ("v2.example", "/"), ("v299.example", "/")], "host string, path string")
    found = {r["host"]: r["vendor"]["vendor"] for r in V.classify(targets, V.vendor_rules(spark, frame)).collect()}
    assert found == {"v1.example": "Vendor 1", "v2.example": "Early", "v299.example": "Vendor 299"}


def test_pages_without_a_policy_stay(spark):
    x = inputs(spark, "/root/testdata/sf0.001")
    sites = x.sites.withColumn("doc_id", F.when(F.col("tab_id") % 2 == 0, F.col("doc_id")))
    pages = N.pages_with_policy(sites, x.facts, x.host_facts)
    rows = {r["tab_id"]: r for r in pages.collect()}
    assert set(rows) == {r["tab_id"] for r in sites.collect()}
    bare = [r for r in rows.values() if r["doc_id"] is None]
    assert bare and all(r["found_sections"] == [] and r["policy_domains"] == [] and r["mentions_advertising"] is False for r in bare)
    analysed = N.analyze(x.requests, pages, N.tab_hosts(x.requests, pages, x.host_facts, x.rules), x.query_keys)
    assert {r["tab_id"] for r in analysed.select("tab_id").collect()} >= {r["tab_id"] for r in bare}


def test_attribution_against_all_pairs(spark):
    pick = random.Random(4)
    hosts = ["a.example", "b.a.example", "c.b.a.example", "x.example", "y.x.example"]
    tabs = [(i, f"{pick.choice(['http', 'https'])}://{pick.choice(hosts)}/p") for i in range(9)]
    changes = []
    for i in range(120):
        partition = pick.choice(["", f"{pick.choice(['http', 'https'])}://{pick.choice([*hosts, 'example'])}"])
        changes.append((i, 0, pick.choice([".", ""]) + pick.choice([*hosts, "z.example"]), pick.random() < 0.4, partition))
    split = lambda url: (url.split("://")[0], url.split("://")[1].split("/")[0])
    covers = lambda high, low: low == high or low.endswith("." + high)
    want = set()
    for change_id, _, domain, removed, partition in changes:
        fits = []
        for tab, url in tabs:
            scheme, host = split(url)
            if partition:
                own, site = split(partition)
                good = scheme == own and (covers(site, host) or covers(host, site))
            else:
                good = covers(domain.lstrip("."), host)
            fits += [tab] * good
        if removed or len(fits) == 1:
            want |= {(change_id, t) for t in fits}
    frame = spark.createDataFrame(changes, "change_id bigint, tab_id bigint, domain string, removed boolean, partition string")
    table = spark.createDataFrame(tabs, "tab_id bigint, url string")
    rows, members = K.attribute(frame, table).collect(), defaultdict(set)
    for r in K.site_tabs(frame, table).collect():
        assert r.tab_id not in members[r.site]
        members[r.site].add(r.tab_id)
    # One row for each change; a delete with its site, whose tabs stand apart.
    assert len({r.change_id for r in rows}) == len(rows)
    got = {(r.change_id, t) for r in rows for t in ([r.tab_id] if r.site is None else members[r.site])}
    assert got == want


def test_sets_give_one_row_for_any_number_of_tabs(spark):
    tabs = spark.range(3000).select(F.col("id").alias("tab_id"), F.lit("https://a.example/").alias("url"))
    changes = spark.range(3000).select(
        F.col("id").alias("change_id"), F.lit(0).alias("tab_id"), F.lit("a.example").alias("domain"), F.lit(False).alias("removed"), F.lit("").alias("partition")
    )
    assert K.attribute(changes, tabs).count() == 0


@pytest.mark.parametrize(
    ("host", "private"),
    [
        ("0x7f.0.0.1", True), ("127.1", True), ("2130706433", True), ("010.0.0.1", False), ("0300.0250.1.1", True), ("10.1", True),
        ("192.168.257", True), ("8.8.8.8", False), ("8.8.8.8.", False), ("256.1.1.1", False), ("0x08080808", False), ("a.example.org", False),
    ],
)
def test_notations_of_addresses(spark, host, private):
    assert spark.range(1).select(U.private_host(F.lit(host))).first()[0] is private


def test_sites_below_country_codes(spark):
    want = {
        "www.ox.ac.uk": "ox.ac.uk", "bar.edu.au": "bar.edu.au", "a.foo.com.mx": "foo.com.mx", "s.x.co.za": "x.co.za",
        "a.b.github.io": "b.github.io", "w.shop.de": "shop.de", "a.b.co.kr": "b.co.kr",
    }
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    rows = H.host_dimension(hosts, H.suffix_rules(spark)).collect()
    assert {r["host"]: r["registrable"] for r in rows} == want


def test_tracker_hosts_with_a_trailing_dot(spark):
    found = spark.range(1).select(U.is_tracker(F.lit("www.google-analytics.com."), F.lit("/x")), U.is_tracker(F.lit("a.example."), F.lit("/x"))).first()
    assert tuple(found) == (True, False)


def test_long_markup_is_read_whole():
    page = "<p>" + "word " * 400_000 + "</p><main>" + "<i>" * 500 + "end" + "</main>tail"
    assert visible_text(page) == "end"
    assert visible_text("<p>" + "word " * 400_000 + "last").endswith("last")
    assert visible_text("one two", max_chars=3) == "one"
    by_name = defaultdict(str, a=visible_text("<main>x<p hidden>y<b>z</p>w</main>"))
    assert by_name["a"] == "x w"


def test_decomposed_hangul_is_put_together(spark):
    import unicodedata

    from clausetrail.functions import text as T

    texts = ["이메일을 수집합니다.", "개인정보 처리방침 값 닭", "plain text", "가\u11a8 각\u11a8 \u1100 \u1161"]
    rows = [(i, unicodedata.normalize("NFD", t) if i < 3 else t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "i int, t string")
    got = frame.select("i", T.nfkc(F.col("t")).alias("c"), T.data_categories(T.tokens(F.col("t"))).alias("d")).orderBy("i").collect()
    assert [r["c"] for r in got] == [unicodedata.normalize("NFKC", t) for _, t in rows]
    assert [d["id"] for d in got[0]["d"]]


def _assigned():
    """Characters this Python knows, so that both sides have the same tables for them."""
    import unicodedata

    from hypothesis import strategies as st

    known = st.characters(min_codepoint=32, max_codepoint=0x2FFFF, blacklist_categories=("Cs", "Cn", "Co"))
    pieces = st.one_of(st.text(known, max_size=6), st.sampled_from(["\ufb03", "\uff21\uff42", "e\u0301\u0323", "\u1e9b\u0323", "\u00bd", "\u2460", "\u33a5", "\uff76\uff9e", "\u1112\u1161\u11ab", "\u212b"]))
    return st.lists(st.lists(pieces, max_size=5).map("".join), min_size=1, max_size=60), unicodedata


def test_tokens_are_in_nfkc(spark):
    """Ligatures, full-width pairs and marks, against the standard library."""
    from hypothesis import given, settings

    from clausetrail.functions import text as T

    texts, unicodedata = _assigned()

    @settings(max_examples=12, deadline=None)
    @given(texts)
    def check(rows):
        frame = spark.createDataFrame(list(enumerate(rows)), "i int, t string").coalesce(1)
        got = frame.select("i", T.nfkc(F.col("t")).alias("c")).orderBy("i").collect()
        assert [r["c"] for r in got] == [unicodedata.normalize("NFKC", t) for t in rows]

    check()
    row = spark.createDataFrame([("of\ufb01cial e\uff4dail \uff30\uff28\uff2f\uff2e\uff25 \ucfe0\ud0a4", None)], "t string, n string").select(T.tokens(F.col("t")), T.tokens(F.col("n"))).first()
    assert tuple(row) == ("official email phone \ucfe0\ud0a4", "")


@pytest.mark.parametrize(
    ("host", "private"),
    [
        ("[2606:4700::1111]", False), ("[::1]", True), ("[::]", True), ("[fe80::1]", True), ("[fc00::1]", True), ("[2001:db8::1]", True),
        ("[::ffff:10.0.0.1]", True), ("[::ffff:8.8.8.8]", False), ("[2002:0a00:0001::]", True), ("[2002:0808:0808::1]", False),
        ("[64:ff9b::a00:1]", True), ("[64:ff9b::808:808]", False), ("[2001::1]", True), ("[ff02::1]", True), ("[1::2::3]", True),
        ("[2a00:1450:4001:81b:0:0:0:200e]", False), ("[2a00:1450]", True), ("[::300.1.1.1]", True),
    ],
)
def test_ipv6_hosts(spark, host, private):
    assert spark.range(1).select(U.private_host(F.lit(host))).first()[0] is private


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        ("https://a.example/x/../y/./z", "a.example", "/y/z"), ("https://a.example/../..", "a.example", "/"), ("https://a.example/x/..", "a.example", "/"),
        ("https://a.example/x/%2e%2E/y", "a.example", "/y"), ("https://a.example/.well-known/p", "a.example", "/.well-known/p"),
        ("https://0x7f.1/p", "127.0.0.1", "/p"), ("https://256.1.1.1/p", None, None), ("https://a.example./p", "a.example.", "/p"), ("https://a.example/x//y/.", "a.example", "/x//y/"),
    ],
)
def test_urls_come_in_one_form(spark, url, host, path):
    got = spark.range(1).select(U.parts(F.lit(url)).alias("p")).first()["p"]
    assert (got and (got["host"], got["path"])) == (host and (host, path))
