"""Rules that must fire and rules that must be vetoed, on small texts of our own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clausetrail.functions import text as T
from clausetrail.functions import urls as U
from clausetrail.functions.patterns import alternatives, anchors, java_pattern, matches, quick_any
from clausetrail.operators import hosts as H
from clausetrail.operators import policy as P
from clausetrail.operators import sections as S
from clausetrail.sources import documents as D

CASES = [
    ("broad_data_sharing", "We may sell personal information to business partners.", True),
    ("broad_data_sharing", "We do not sell personal information to partners.", False),
    ("broad_data_sharing", "We never sell data and may share data with third parties.", True),
    ("broad_data_sharing", "개인정보를 판매하지 않으며 제휴사와 공유합니다.", True),
    ("broad_data_sharing", "제3자에게 이메일을 제공할 수 있고 개인정보를 공유합니다.", True),
    ("children", "We process data of children under 13.", True),
    ("children", "We do not knowingly collect data from children.", False),
    ("behavioral_ads", "You will see personalized ads.", True),
    ("behavioral_ads", "We will not show targeted ads.", False),
    ("account_termination", "The company may suspend your account.", True),
    ("account_termination", "You may terminate your subscription.", False),
    ("policy_change", "We may modify these terms.", True),
    ("policy_change", "We will not modify these terms.", False),
    ("retention_unclear", "We keep data indefinitely.", True),
    ("retention_unclear", "We retain it as necessary for 30 days, as long as necessary.", False),
    ("overseas_transfer", "Data may go outside your country.", True),
    ("arbitration", "Disputes go to binding arbitration.", True),
    ("arbitration", "We do not require binding arbitration.", False),
    ("liability_limit", "We disclaim all warranties.", True),
    ("security_vague", "We use industry standard measures.", True),
    ("security_vague", "We use industry standard measures and encryption.", False),
]


def test_risk_rules_fire_and_are_vetoed(spark):
    rows = spark.createDataFrame([(i, text) for i, (_, text, _) in enumerate(CASES)], "doc_id bigint, body string")
    prepared = P.with_clauses(P.with_sentences(P.with_text(rows)))
    found = prepared.select("doc_id", *[P.rule_evidence(r).isNotNull().alias(r.id) for r in P.RULES.values()])
    by_id = {r["doc_id"]: r for r in found.collect()}
    wrong = [(rule, text) for i, (rule, text, want) in enumerate(CASES) if by_id[i][rule] != want]
    assert wrong == []


GATE = [
    ("", "empty"),
    ("Welcome to our shop. Ship faster today.", "not_policy"),
    ("Privacy Policy", "not_policy"),
    ("Privacy Policy and Terms of Use. Our servers sort data about rainfall and tides.", "not_policy"),
    ("Privacy Policy. This article explains how a bakery collects personal information.", "not_policy"),
    ("Privacy Policy. Readers have the right to delete their personal data at any time.", "analyzed"),
    ("We collect your email address and phone number when you order bread.", "analyzed"),
    ("Terms of Service. By opening the door, you agree to be bound by these terms.", "not_policy"),
    ("Terms of Service. Acceptable use rules forbid spam. Intellectual property rights in recipes stay with the cooks.", "analyzed"),
    ("회사는 주문을 받을 때 전화번호와 주소를 수집합니다.", "analyzed"),
    ("이용약관. 가게에 들어오면 이 약관에 동의합니다.", "not_policy"),
]


def test_document_gate(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GATE)], "doc_id bigint, body string")
    got = {r["doc_id"]: r["status"] for r in P.analyze(rows).collect()}
    assert [(GATE[i][0], s) for i, s in sorted(got.items())] == GATE


def test_oversize_text_is_bounded_and_covered_by_windows(spark):
    body = "word " * 30_000
    row = spark.createDataFrame([(1, body)], "doc_id bigint, body string").select(
        T.bounded(F.col("body"), 120_000).alias("t"), T.bounded(F.col("body")).alias("all")
    )
    got = row.select(F.length("t").alias("n"), F.length("all").alias("m"), T.windows(F.col("t")).alias("w")).first()
    assert (got["n"], got["m"]) == (119_999, 149_999)
    assert got["w"][0] + "".join(w[160:] for w in got["w"][1:]) == body[:119_999]


def test_analysis_agrees_with_and_without_literal_guards(spark):
    texts = ["We share DATA", "제3자 제공", "nothing", "third-party affiliates", "under  13", "ＦＵＬＬ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for rule in P.RULES.values():
        for group in rule.needs:
            got = df.select(
                quick_any(F.col("t"), F.lower("t"), group).alias("quick"), matches(F.col("t"), "|".join(group)).alias("slow")
            ).collect()
            assert all(r["quick"] == r["slow"] for r in got)


def test_pattern_helpers():
    assert alternatives(r"a(b|c)|d[|]e|f\|g") == ["a(b|c)", "d[|]e", r"f\|g"]
    assert anchors(r"\b(?:share|sell)\b") == {"share", "sell"}
    assert anchors(r"\d+\s*days") is None
    assert java_pattern(r"\bok\b", False) == r"(?<!\w)ok(?!\w)"


def test_english_words_beside_hangul(spark):
    df = spark.createDataFrame([("email을 보냅니다",)], "t string")
    assert df.select(matches(F.col("t"), r"\bemail\b")).first()[0]


def test_data_words(spark):
    def found(text):
        return spark.createDataFrame([(text,)], "t string").select(T.data_categories(T.tokens(F.col("t"))).alias("c")).first()["c"]

    assert [c["id"] for c in found("Your IP addresses are logged")] == ["device"]
    assert [c["id"] for c in found("Your address and nationalities")] == ["identity", "contact"]
    assert [c["id"] for c in found("ＥＭＡＩＬ and userName")] == ["identity", "contact"]


def test_sections_and_fallback_titles(spark):
    body = "Intro text that is long enough to be kept here\nHow we use information\nWe provide the service to you and support it.\nSecurity measures\nWe use encryption and access control everywhere."
    rows = S.section_rows(spark.createDataFrame([(1, body)], "doc_id bigint, body string")).collect()
    found = {r["section_id"] for r in rows if r["found"]}
    assert len(rows) == 13 and {"purpose", "security"} <= found
    assert next(r for r in rows if r["section_id"] == "security")["evidence"][0]["title"] == "Security measures"


HOSTS = [
    ("a.b.example.co.uk", "example.co.uk"),
    ("co.uk", "co.uk"),
    ("x.y.ck", "x.y.ck"),
    ("www.ck", "www.ck"),
    ("a.www.ck", "www.ck"),
    ("a.b.kawasaki.jp", "a.b.kawasaki.jp"),
    ("x.city.kawasaki.jp", "city.kawasaki.jp"),
    ("alice.pages.example", "alice.pages.example"),
    ("host.unknowntld", "host.unknowntld"),
    ("10.1.2.3", "10.1.2.3"),
    ("localhost", "localhost"),
]


def test_registrable_domains(spark):
    df = spark.createDataFrame([(h,) for h, _ in HOSTS], "host string")
    got = {r["host"]: r["registrable"] for r in H.host_dimension(df, H.suffix_rules(spark)).collect()}
    assert got == dict(HOSTS)


def test_suffix_list_from_a_file(spark, tmp_path):
    path = tmp_path / "suffixes.txt"
    path.write_text("// comment\ncom\n*.zz\n!free.zz\n\n")
    rules = H.suffix_rules(spark, str(path))
    df = spark.createDataFrame([("a.b.com",), ("a.b.c.zz",), ("x.free.zz",)], "host string")
    got = {r["host"]: r["registrable"] for r in H.host_dimension(df, rules).collect()}
    assert got == {"a.b.com": "b.com", "a.b.c.zz": "b.c.zz", "x.free.zz": "free.zz"}


NAMES = [
    ("user_8f3e2a1b9c7d6e5f", "user___hex__"),
    ("id-3f2504e0-4f89-11d3-9a0c-0305e82c3301", "id-__uuid__"),
    ("order123456789", "order__number__"),
    ("tokenAbC123dEf456GhI789jKl012", "__token__"),
    ("session_AbC123dEf456GhI789jKl012", "session___token__"),
    ("_ga_XYZ", "_ga___identifier__"),
    ("myEmailThing", "email__identifier__"),
    ("zzz", "__identifier__"),
    ("page", "page"),
]


def test_masked_names(spark):
    df = spark.createDataFrame([(n,) for n, _ in NAMES], "n string")
    got = [(r["n"], r["m"]) for r in df.select("n", U.masked_name(F.col("n")).alias("m")).collect()]
    assert got == NAMES


URLS = [
    ("https://example.com/a", None),
    ("http://example.com/", "not_https"),
    ("ftp://example.com/", "scheme"),
    ("not a url", "invalid_url"),
    ("https://u:p@example.com/", "credentials"),
    ("https://192.168.1.1/", "private_host"),
    ("https://172.20.0.1/", "private_host"),
    ("https://8.8.8.8/", None),
    ("https://[::1]/", "private_host"),
    ("https://intranet/", "private_host"),
    ("https://example.com/?api_key=1", "secret_query"),
    ("https://example.com/?apiKey=1", "secret_query"),
    ("https://example.com/?lang=en", None),
    ("https://example.com/" + "x" * 2048, "invalid_url"),
]


def test_document_admission(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URLS)], "i bigint, u string")
    got = [r["c"] for r in df.select("i", D.url_category(F.col("u")).alias("c")).orderBy("i").collect()]
    assert got == [c for _, c in URLS]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://a.com/p?lang=en&v=1.2", "https://a.com/p?lang=en&v=1.2"),
        ("https://a.com/p?lang=en&lang=ko", None),
        ("https://a.com/p?lang=en-not-a-locale-value", None),
        ("https://a.com/p?LANG=en", None),
        ("https://a.com/p#x", None),
        ("http://a.com/p", None),
    ],
)
def test_canonical_policy_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(U.canonical_policy_url(F.col("u"))).first()[0] == want
