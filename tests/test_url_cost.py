"""URLs are taken apart by one match, and costly rows are dealt over all tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausetrail.functions import urls as U
from clausetrail.plans.inputs import Inputs

URLS = [
    "https://u:p@Shop.example:443/a/../b?x=1&y#top", "http://[::1]:8080", "ftp://a.example/", "https://a.example", "http://0x7f.1/?q",
    "https://a.example/a\nb?c#d", "https://a.example/#f\u0085", "https://a.example/\u0085", "https://a b/", " https://[a@b:c]/ ", "", None,
]


def test_one_match_gives_all_parts_of_a_url(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "u string")
    plain = F.when(F.col("u").rlike(U.URL), F.array(*[U.url_part(F.col("u"), i) for i in range(1, 8)]))
    one = F.filter(F.array(U.url_groups(F.col("u"))), lambda g: F.size(g) == 7)
    got = rows.select(plain.alias("plain"), F.try_element_at(one, F.lit(1)).alias("one")).collect()
    assert [r.plain for r in got] == [r.one for r in got] and sum(r.plain is not None for r in got) == 7
    # Pattern tests beyond those for texts with line ends: one.
    plan = rows.select(U.parts(F.col("u")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("://(?:([^/?#@]*)@)?") <= 9


def test_short_names_and_plain_keys_stay_as_they_were(spark):
    names = ["user_x1y2", "__Host-sid_abc", "a" * 15, "deadbeef01234567", "\u0001uuid\u0001", "n1234567", "cart"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in rows.select(U.masked_name(F.col("n"))).collect()]
    assert got[3] == "__hex__" and got[4] == "__uuid__" and got[5] == "n__number__" and got[6] == "cart"
    pairs = spark.sql("select 'a+b=%41&+=%zz&c=1' as q").select(U.query_pairs(F.col("q"))).first()[0]
    assert [tuple(p) for p in pairs] == [("a b", "A"), (" ", "%zz"), ("c", "1")]


def test_changes_are_dealt_out_before_names_are_masked(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr("clausetrail.plans.inputs.stage", lambda df, name: seen.setdefault(name, df))
    changes = Inputs(spark, "/root/testdata/sf0.001").changes
    plan = changes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Repartition") < plan.index("Join")
