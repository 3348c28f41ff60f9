"""Pairs dealt over all tasks, no stage of pages through the driver, pages without a policy spread."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausetrail.operators import alignment as A
from clausetrail.operators import cookies as K
from clausetrail.operators import jurisdiction as J
from clausetrail.operators import network as N
from clausetrail.plans.inputs import inputs

SF = "/root/testdata/sf0.001"


def test_few_deletes_with_many_tabs_are_worked_on_by_many_tasks(spark, monkeypatch):
    """What comes out decides how pairs are dealt, not the few bytes that go in."""
    monkeypatch.setattr(K, "TABS_PER_BLOCK", 8)
    monkeypatch.setattr(K, "DELETES_PER_SLICE", 8)
    attributed = spark.createDataFrame([(i, None, "s") for i in range(64)], "change_id bigint, tab_id bigint, site string")
    members = spark.createDataFrame([("s", i) for i in range(64)], "site string, tab_id bigint")
    pairs = K.with_tabs(attributed, members)
    per_task = pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in per_task) == pairs.distinct().count() == 64 * 64
    assert len(per_task) >= 6 and max(r["count"] for r in per_task) < 64 * 64 / 2


def test_changes_without_partition_or_domain_and_twice(spark):
    rows = [(1, "a.example", False, None), (1, "a.example", False, None), (2, None, True, ""), (3, None, True, "https://a.example"), (4, "x", True, "no url")]
    changes = spark.createDataFrame(rows, "change_id bigint, domain string, removed boolean, partition string")
    tabs = spark.createDataFrame([(7, "https://a.example/x")], "tab_id bigint, url string")
    got = sorted(map(str, K.attribute(changes, tabs).collect()))
    want = ["Row(change_id=1, tab_id=7, site=None)"] * 2 + ["Row(change_id=3, tab_id=None, site='https://a.example')"]
    assert got == want


def small(spark, columns: str):
    return spark.createDataFrame([], columns)


def joins(df) -> tuple[int, int]:
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")


def test_pages_and_signals_of_them_are_not_sent_through_the_driver(spark):
    x = inputs(spark, SF)
    pages, observed, network, sites = (small(spark, df.schema) for df in (x.pages, x.observed, x.network, x.sites))
    assert joins(J.check(pages, observed, J.detect(sites))) == (2, 0)
    assert joins(A.checks(pages, observed, small(spark, N.vendor_summary(x.hosts).schema))) == (1, 0)
    assert joins(N.host_country_signals(network, sites)) == (1, 0)


def test_pages_without_a_document_are_spread(spark):
    pages = spark.createDataFrame([(i, None) for i in range(400)] + [(400, 1), (401, 1), (402, 2)], "tab_id bigint, doc_id bigint")
    documents = spark.createDataFrame([(1, "a"), (None, "never")], "doc_id bigint, text string")
    met = N.with_document(pages, documents)
    assert met.columns == ["doc_id", "tab_id", "text"]
    assert sorted((r.tab_id, r.text) for r in met.collect() if r.text) == [(400, "a"), (401, "a")] and met.count() == 403
    keys = met._jdf.queryExecution().sparkPlan().toString()
    assert "_spread" in next(line for line in keys.splitlines() if "SortMergeJoin" in line)
