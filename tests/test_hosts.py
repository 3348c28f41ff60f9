"""Sites by complete suffix lists, and hosts in one form."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clausetrail.functions import urls as U
from clausetrail.operators import hosts as H
from clausetrail.sources import suffixes as SX

# Host and site, as the published rules have them.
SITES = {
    "www.impots.gouv.fr": "impots.gouv.fr",
    "a.service.gouv.fr": "service.gouv.fr",
    "x.a.netlify.app": "a.netlify.app",
    "b.netlify.app": "b.netlify.app",
    "x.a.herokuapp.com": "a.herokuapp.com",
    "x.s3.amazonaws.com": "x.s3.amazonaws.com",
    "www.foo.ai": "foo.ai",
    "api.foo.ai": "foo.ai",
    "www.foo.co.de": "co.de",
    "www.x.foo.ck": "x.foo.ck",
    "a.www.ck": "www.ck",
    "x.city.kawasaki.jp": "city.kawasaki.jp",
    "x.y.other.kawasaki.jp": "y.other.kawasaki.jp",
    "www.ox.ac.uk": "ox.ac.uk",
    "a.b.co.kr": "b.co.kr",
    "a.alice.pages.example": "alice.pages.example",
    "com": "com",
    "8.8.8.8": "8.8.8.8",
    "www.shop.de.": "shop.de",
    "www.bücher.de": "xn--bcher-kva.de",
    "www.xn--bcher-kva.de": "xn--bcher-kva.de",
    "a.食狮.公司.cn": "xn--85x722f.xn--55qx5d.cn",
}


def test_sites_of_the_complete_list(spark):
    assert len(SX.default_rules()) > 9000
    hosts = spark.createDataFrame([(h,) for h in SITES], "host string")
    rows = H.host_dimension(hosts, H.suffix_rules(spark)).collect()
    assert {r["host"]: r["registrable"] for r in rows} == SITES


def test_an_own_list_by_path_or_setting(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// own\ncom\n*.wild.com\n!not.wild.com  comment\nbücher.example\n")
    hosts = spark.createDataFrame([("a.b.c.wild.com",), ("x.not.wild.com",), ("a.b.xn--bcher-kva.example",), ("a.b.org",)], "host string")
    want = {"a.b.c.wild.com": "b.c.wild.com", "x.not.wild.com": "not.wild.com", "a.b.xn--bcher-kva.example": "b.xn--bcher-kva.example", "a.b.org": "a.b.org"}
    spark.conf.set(SX.SETTING, str(tmp_path / "list.dat"))
    try:
        for rules in (H.suffix_rules(spark), H.suffix_rules(spark, str(tmp_path / "list.dat"))):
            assert {r["host"]: r["registrable"] for r in H.host_dimension(hosts, rules).collect()} == want
    finally:
        spark.conf.unset(SX.SETTING)
    assert SX.parsed((tmp_path / "list.dat").read_text()) == [("com", "exact"), ("wild.com", "wildcard"), ("not.wild.com", "exception"), ("xn--bcher-kva.example", "exact")]


def test_large_lists_are_not_broadcast(spark, monkeypatch):
    plan = lambda: H.suffix_rules(spark)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan() or "broadcast" in plan()
    monkeypatch.setattr(H, "BROADCAST_CHARS", 100)
    assert "broadcast" not in plan().lower()


def test_the_short_list_serves_where_the_runtime_has_none(monkeypatch):
    monkeypatch.setattr(SX, "runtime_home", lambda: None)
    assert SX._from_runtime() == [] and ("co.uk", "exact") in SX.short_list()


def test_trackers_with_a_trailing_dot_in_the_dimension(spark):
    hosts = spark.createDataFrame([("www.google-analytics.com.",), ("WWW.Google-Analytics.com",), ("a.example.",)], "host string")
    rows = H.host_dimension(hosts, H.suffix_rules(spark)).collect()
    assert {r["host"]: r["tracker_domain"] for r in rows} == {"www.google-analytics.com.": True, "WWW.Google-Analytics.com": True, "a.example.": False}


@pytest.mark.parametrize(
    ("url", "host"),
    [("https://BÜCHER.de/x", "xn--bcher-kva.de"), ("https://a。b.example/", "a.b.example"), ("https://ليهمابتكلموشعربي.example./", "xn--mgbcah9ar9a4efegftvvn.example."), ("https://" + "é" * 80 + ".example/", "é" * 80 + ".example"), ("https://plain.example/", "plain.example")],
)
def test_urls_have_ascii_hosts(spark, url, host):
    assert spark.range(1).select(U.parts(F.lit(url))["host"].alias("h")).first()["h"] == host
