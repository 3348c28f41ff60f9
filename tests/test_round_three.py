"""Reports without broadcasts, deletes with all their tabs, and texts searched by their words."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions.patterns import BLANK, BLANK_CHARS, BLANKS, hints, quick_any, words_of
from clausetrail.operators import cookies as K
from clausetrail.operators import report as RP
from clausetrail.plans.inputs import inputs
from clausetrail.streaming import sessions as SE

SF = "/root/testdata/sf0.001"


def test_reports_send_no_stage_through_the_driver(spark):
    x = inputs(spark, SF)
    parts = [x.sites, x.policy, x.network, x.forms, x.storage, x.consent, x.delta, x.jurisdiction, x.alignment]
    own = [spark.createDataFrame([], p.schema) for p in parts]
    plan = RP.site_reports(*own)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 8


def cookie_rows(spark):
    tabs = spark.createDataFrame([(i, f"https://{'ab'[i % 2]}.example/") for i in range(50)], "tab_id bigint, url string")
    rows = [(i, 0, f"{'abz'[i % 3]}.example", i % 2 == 0, "") for i in range(30)] + [(30, 0, "only.example", False, "")]
    changes = spark.createDataFrame(rows, "change_id bigint, tab_id bigint, domain string, removed boolean, partition string")
    return changes, tabs.unionByName(spark.createDataFrame([(99, "https://only.example/")], tabs.schema))


def test_a_delete_has_a_row_for_every_tab_of_its_site(spark, monkeypatch):
    monkeypatch.setattr(K, "TABS_PER_BLOCK", 4)
    changes, tabs = cookie_rows(spark)
    got = [tuple(r) for r in K.with_tabs(K.attribute(changes, tabs), K.site_tabs(changes, tabs)).collect()]
    want = {(i, t) for i in range(0, 30, 2) for t in range(50) if i % 3 == t % 2} | {(30, 99)}
    assert len(got) == len(set(got)) and set(got) == want


def test_excluded_tabs_get_no_delete(spark):
    changes, tabs = cookie_rows(spark)
    origins = tabs.select("tab_id", F.regexp_extract("url", "^https://[^/]+", 0).alias("origin"))
    excluded = spark.createDataFrame([("https://a.example",), ("https://only.example",)], "origin string")
    got = SE.paused_out(K.attribute(changes, tabs), K.site_tabs(changes, tabs), origins, excluded).collect()
    assert sorted(map(tuple, got)) == sorted((i, t) for i in range(0, 30, 2) if i % 3 == 1 for t in range(1, 50, 2))


def test_one_blank_is_what_the_list_of_blanks_says(spark):
    chars = spark.range(1, 0xFFFF).filter("id not between 55296 and 57343")
    text = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    odd = chars.select(text.alias("c")).filter(F.col("c").rlike(f"^{BLANK}$") != F.col("c").rlike(rf"^[{BLANKS}]$"))
    assert odd.count() == 0
    assert sorted(map(ord, BLANK_CHARS)) == sorted(ord(r.c) for r in chars.select(text.alias("c")).filter(F.col("c").rlike(f"^{BLANK}$")).collect())


def test_hints_lose_no_match(spark):
    """Sections, gate and rules found by hints are those found by looking for every word in the whole text."""
    pick, patterns = random.Random(3), [p for _, headings, contents in R.SECTION_RULES for p in (*headings, *contents)]
    words = sorted({w for p in patterns for w in words_of([p])})
    pieces = [*words, "Third-Parties", "xx", "pre", "recollected", "의", "É"]
    texts = ["".join(pick.choice([p, p.upper(), p[1:], p[:-1]]) + pick.choice([" ", "\n", "", ", ", " "]) for p in pick.choices(pieces, k=12)) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("low", F.lower("t"))
    rows = rows.withColumn("found", hints(F.col("t"), words))
    plain = F.array(*[quick_any(F.col("t"), F.col("low"), [p]) for p in patterns])
    quick = F.array(*[quick_any(F.col("t"), F.col("low"), [p], F.col("found")) for p in patterns])
    assert rows.filter(plain != quick).count() == 0
    assert rows.filter(F.exists(plain, lambda x: x)).count() > 300
    # Text without any of the words leaves nothing to look through.
    assert spark.createDataFrame([("the tide comes home with nine small boats",)], "t string").select(hints(F.col("t"), words)).first()[0] == ""


def test_a_tab_without_an_id_keeps_its_row(spark):
    attributed = spark.createDataFrame([(1, None, "s"), (2, 7, None)], "change_id bigint, tab_id bigint, site string")
    members = spark.createDataFrame([("s", None), ("s", 5)], "site string, tab_id bigint")
    got = {tuple(r) for r in K.with_tabs(attributed, members).collect()}
    assert got == {(1, None), (1, 5), (2, 7)}
