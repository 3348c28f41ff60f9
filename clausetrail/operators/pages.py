"""Pages before analysis: the part worth reading and whether it looks like a policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausetrail import rules as R


def hint_count(text: Column, hints: list[str]) -> Column:
    return sum((F.contains(text, F.lit(h)).cast("int") for h in hints), F.lit(0))


def readable_score(text: Column, attrs: Column) -> Column:
    """Length, hints in the attributes (three points each) and in the text (one each)."""
    seen = F.substring(text, 1, R.READABLE_SCORE_CHARS)
    score = (
        F.least(F.length(seen) / F.lit(1000.0), F.lit(20.0))
        + 3 * hint_count(F.lower(attrs), R.READABLE_HINTS)
        + hint_count(F.lower(seen), R.READABLE_HINTS)
    )
    return F.when(F.length(seen) < R.READABLE_MIN_CHARS, F.lit(0.0)).otherwise(score)


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The best block of each page: (tab_id, el_id, score); the first one wins a tie."""
    scored = candidates.withColumn("score", readable_score(F.col("text"), F.col("attrs")))
    best = scored.groupBy("tab_id").agg(F.max_by(F.struct("el_id", "score"), F.struct("score", -F.col("el_id"))).alias("b"))
    return best.select("tab_id", "b.el_id", F.round("b.score", 6).alias("score"))


def page_gate(pages: DataFrame) -> DataFrame:
    """Adds ``gate_score``, ``confidence`` and ``policy_like``.

    ``pages``: (path, title, headings array, text).  A cheap test to run before any analysis.
    """
    path, title, text = F.lower("path"), F.lower(F.substring("title", 1, 512)), F.lower("text")
    step = pages.withColumn("_p", hint_count(path, R.PATH_PAGE_HINTS)).withColumn("_t", hint_count(title, R.STRONG_PAGE_HINTS))
    step = (
        step.withColumn("_l", hint_count(F.substring(text, 1, 800), R.STRONG_PAGE_HINTS))
        .withColumn("_s", hint_count(text, R.STRONG_PAGE_HINTS))
        .withColumn("_u", hint_count(text, R.SUPPORTING_PAGE_HINTS))
        .withColumn("_h", F.size(F.filter("headings", lambda h: hint_count(F.lower(h), R.STRONG_PAGE_HINTS) > 0)))
    )

    def capped(name: str, most: int, weight: float) -> Column:
        return F.least(F.col(name), F.lit(most)) * F.lit(weight)

    score = (
        capped("_p", 1, 4.0)
        + capped("_t", 1, 3.0)
        + capped("_l", 1, 4.0)
        + capped("_s", 3, 1.5)
        + capped("_u", 4, 0.75)
        + capped("_h", 2, 1.5)
        + F.when(F.length("text") >= 1200, 0.5).otherwise(0.0)
    )
    step = step.withColumn("gate_score", score)
    named = (F.col("_t") > 0) | (F.col("_l") > 0) | (F.col("_u") >= 2) | (F.col("_h") > 0)
    return step.withColumn("policy_like", (F.length("text") >= 600) & (F.col("gate_score") >= 4) & named).withColumn(
        "confidence", F.floor(F.least(F.lit(0.99), F.col("gate_score") / 10) * 100 + 0.5) / 100
    ).drop("_p", "_t", "_l", "_s", "_u", "_h")
