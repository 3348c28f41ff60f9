"""Cheaper ways through texts give what the plain ways give."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions import text as T
from clausetrail.functions.patterns import BLANK, fold_blanks, known_of, knows_any, one_space, starts_of
from clausetrail.operators import policy as P
from clausetrail.operators import sections as S


def test_an_excerpt_of_a_long_text_is_that_of_the_whole(spark):
    texts = ["ab " * 200, "a" + " " * 900 + "b" * 300, " " * 900 + "cd", "x" * 81, "x " * 40, "", "a \n" * 90]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("whole", fold_blanks(F.col("t")))
    got = rows.select(T.excerpt(F.col("t"), 20).alias("e"), "whole").collect()
    assert [r.e for r in got] == [r.whole if len(r.whole) <= 20 else r.whole[:17] + "..." for r in got]


def test_starts_of_words_fail_at_the_first_two_letters():
    words = ["data", "delete", "do", "쿠키", "retain"]
    pattern = starts_of(words)
    assert pattern.startswith("(?=[dr][aeo])")
    assert all(re.match(pattern, w) for w in words) and not any(re.match(pattern, w) for w in ("rota", "dxta", "ata", "데이"))


def test_known_words_tell_the_sections_that_can_score(spark):
    rows = spark.createDataFrame([("cookies",), ("third-parties",), ("",)], "h string")
    known = known_of(F.col("h"), S.SECTION_WORDS)
    headings = {section: [*h, *c] for section, h, c in R.SECTION_RULES}
    got = rows.select(*[knows_any(known, p).alias(s) for s, p in headings.items()]).collect()
    assert got[0]["cookies_tracking"] and got[1]["third_party"] and not any(got[2])
    blocks = spark.sql("select array(named_struct('idx', 0, 'title', 'Cookies', 'block', 'Cookies\nWe use cookies and more.')) b")
    scored = {s: len(x) for s, x in blocks.select(F.inline(S.section_scores(F.col("b")))).collect()}
    assert scored["cookies_tracking"] == 1 and scored["security"] == 0


def test_words_in_camel_case_part_as_before(spark):
    text = "userName2Id HTTPServer aBC x1Y ÉA"
    assert spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t"))).first()[0] == "user name2 id http server a bc x1 y a"


def test_single_spaces_stay_as_they_are_and_other_runs_become_one(spark):
    texts = [a + b + c for a in ("", " ", "\t", "x ") for b in ("", " ", "\n", "\xa0", " \u3000", "  y") for c in ("", " ", "\r\n", "z")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for blank in (BLANK, "[ \t\n]", "[ \t]", "[^a-z]"):
        plain = F.regexp_replace("t", f"{blank}+", " ")
        assert rows.filter(one_space(F.col("t"), blank) != plain).count() == 0


def test_an_analysis_searches_sentences_once_for_all_words(spark, monkeypatch):
    texts = [
        "Privacy Policy. We collect your email address. We may sell your personal data to third parties.",
        "Terms of Service. You agree to arbitration. You agree to be bound by these terms.",
        "개인정보 처리방침. 회사는 이메일을 수집합니다.",
        "Nothing here.",
        "",
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, body string")
    gated = P.with_gate(P.with_sentences(P.with_text(rows)))
    apart = P.with_risks(gated, F.col("status") == "analyzed").select("doc_id", "status", "risks").collect()
    searched, hints = [], P.hints
    monkeypatch.setattr(P, "hints", lambda text, words: searched.append(set(words)) or hints(text, words))
    got = P.analyze(rows).select("doc_id", "status", "risks").collect()
    assert sorted(got) == sorted(apart) and any(r.risks for r in got)
    assert searched == [P.GATE_WORDS | P.RISK_WORDS]
