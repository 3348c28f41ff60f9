"""Policy documents: is it a policy, what does it collect, which clauses are risky.

Every step works on the row of one document with array functions, so a whole analysis is a
single map over the input: no shuffle, no explode, nothing held beyond one document.
The ``*_rows`` functions give the exploded tables where those are wanted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions import findings as FN
from clausetrail.functions import text as T
from clausetrail.functions.patterns import anchors, hinted, hints, holds_any, java_pattern, let, matches, matches_any, quick_any, words_of
from clausetrail.operators.settle import settle

RULES = {rule.id: rule for rule in R.RISK_RULES}


# -- preparation ------------------------------------------------------------------------


def with_text(policies: DataFrame, body: str = "body", max_chars: int | None = None) -> DataFrame:
    """Adds ``text``; drops the raw body so it is not carried further."""
    return policies.withColumn("text", T.bounded(F.col(body), max_chars)).drop(body)


def with_sentences(policies: DataFrame) -> DataFrame:
    return policies.withColumn("sentences", T.sentences(F.col("text")))


def sentence_rows(policies: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per sentence: (key, sent_idx, sentence)."""
    prepared = with_text(policies)
    return rows_of(prepared, T.sentences(F.col("text")), "sent_idx", "sentence", [key])


def clause_rows(policies: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per clause: (key, sent_idx, clause_idx, clause)."""
    rows = sentence_rows(policies, key)
    return rows_of(rows, T.clauses(F.col("sentence")), "clause_idx", "clause", [key, "sent_idx"])


def rows_of(df: DataFrame, items: Column, position: str, name: str, keep: list[str]) -> DataFrame:
    """One row per array item.

    The outer form keeps the optimizer from working out the array a second time just to filter empty ones.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(position, name)).filter(F.col(name).isNotNull())


# -- document gate ----------------------------------------------------------------------


def evidence_text(sentence: Column) -> Column:
    """The sentence with document names ("privacy policy", ...) blanked out, length kept."""
    marker = java_pattern(R.DOCUMENT_MARKER)
    pieces = F.split(sentence, marker)
    names = F.regexp_extract_all(sentence, F.lit(marker), F.lit(0))
    blanked = F.array_join(
        F.zip_with(pieces, names, lambda p, n: F.concat(p, F.coalesce(F.repeat(F.lit(" "), F.length(n)), F.lit("")))), ""
    )
    return F.when(sentence.rlike(marker), blanked).otherwise(sentence)


def leads_with(text: Column, marker: str) -> Column:
    at = F.regexp_instr(text, F.lit(java_pattern(marker)))
    limit = F.least(F.lit(R.MARKER_LEAD_CHARS), F.floor(F.length(text) * R.MARKER_LEAD_SHARE).cast("int"))
    return (at > 0) & (at - 1 <= limit)


def with_lower(text: Column) -> Column:
    return F.struct(text.alias("text"), F.lower(text).alias("lowered"))


def expository(s: Column) -> Column:
    return matches(s["text"], R.EXPOSITORY_FRAME)


def excluded_practice(s: Column) -> Column:
    return expository(s) | matches(s["text"], R.ACCOUNT_HELP)


def names_data(s: Column) -> Column:
    """A word without which no practice pattern can match."""
    return holds_any(s["lowered"], anchors(R.SPECIFIC_OBJECT) | anchors(R.GENERIC_OBJECT))


def names_korean_data(s: Column) -> Column:
    return quick_any(s["text"], s["lowered"], [R.KOREAN_DATA_OBJECT])


def practice_anywhere(s: Column) -> Column:
    """Data practice that counts in any document."""
    text = s["text"]
    english = names_data(s) & (
        matches(text, R.CONTROLLER_SPECIFIC) | (matches(text, R.USER_NEXUS) & matches(text, R.CONTROLLER_GENERIC))
    )
    korean = names_korean_data(s) & matches(text, R.KOREAN_DATA_ACTION) & matches(text, R.KOREAN_CONTROLLER)
    return (english | korean) & ~excluded_practice(s)


def practice_under_title(s: Column) -> Column:
    """Data practice that counts only below a leading privacy title."""
    text = s["text"]
    direct = matches(text, R.DIRECT_SPECIFIC) | matches(text, R.DIRECT_CONCRETE)
    english = names_data(s) & (matches(text, R.CONTROLLER_GENERIC) | (direct & ~matches(text, R.IMPERATIVE_ACTION)))
    return (english | (names_korean_data(s) & matches(text, R.KOREAN_BARE_ACTION))) & ~excluded_practice(s)


def weak_terms_signals(joined: Column) -> Column:
    def count(s: Column) -> Column:
        return sum((quick_any(s["text"], s["lowered"], [p]).cast("int") for p in R.WEAK_TERMS_SIGNALS), F.lit(0))

    return let(with_lower(joined), count)


def telling_sentences(words: set[str], known: Column | None = None) -> Column:
    """(sent_idx, sentence, hints) of the sentences that hold any of the words.

    ``known``: the same for words that cover these, so that the sentences need not be searched again.
    """
    if known is not None:
        return F.filter(known, lambda t: hinted(t["hints"], words))
    every = F.transform("sentences", lambda s, i: F.struct(i.alias("sent_idx"), s.alias("sentence"), hints(s, words).alias("hints")))
    return F.filter(every, lambda t: t["hints"] != "")


def known_sentences(prepared: DataFrame) -> Column | None:
    """What ``analyze`` has searched sentences for already, if it has."""
    return F.col("_known") if "_known" in prepared.columns else None


def hints_of(telling: Column) -> Column:
    return F.array_join(F.transform(telling, lambda t: t["hints"]), " ")


# Words without which no sentence counts as data practice, rights or retention, and those of document names.
GATE_WORDS = words_of([R.SPECIFIC_OBJECT, R.GENERIC_OBJECT, R.KOREAN_DATA_OBJECT, *R.RIGHTS_OR_RETENTION, R.DOCUMENT_MARKER])


def terms_clause(sentences: Column) -> Column:
    def judge(evidence: Column) -> Column:
        plain_text = F.transform(F.filter(evidence, lambda s: ~expository(s)), lambda s: s["text"])
        strong = F.exists(evidence, lambda s: quick_any(s["text"], s["lowered"], R.STRONG_TERMS_CLAUSES) & ~expository(s))
        return strong | (weak_terms_signals(F.array_join(plain_text, " ")) >= 2)

    return let(F.transform(sentences, lambda s: with_lower(evidence_text(s))), judge)


def with_gate(prepared: DataFrame) -> DataFrame:
    """Adds the gate flags, ``policy_confidence`` and ``status`` to documents with sentences."""
    text = F.col("text")
    telling = telling_sentences(GATE_WORDS, known_sentences(prepared))
    step = prepared.withColumn("_telling", telling).withColumn("_hints", hints_of(F.col("_telling")))

    def named(marker: str) -> Column:
        return hinted(F.col("_hints"), words_of([marker]))

    step = (
        step.withColumn("leading_privacy", named(R.PRIVACY_MARKER) & leads_with(text, R.PRIVACY_MARKER))
        .withColumn("leading_terms", named(R.TERMS_MARKER) & leads_with(text, R.TERMS_MARKER))
        .withColumn("has_marker", named(R.DOCUMENT_MARKER) & matches(text, R.DOCUMENT_MARKER))
        .withColumn("evidence", F.transform("_telling", lambda t: with_lower(evidence_text(t["sentence"]))))
    )
    step = (
        step.withColumn(
            "data_practice",
            F.exists("evidence", practice_anywhere) | (F.col("leading_privacy") & F.exists("evidence", practice_under_title)),
        )
        .withColumn(
            "rights_or_retention",
            F.col("leading_privacy")
            & F.exists("evidence", lambda s: quick_any(s["text"], s["lowered"], R.RIGHTS_OR_RETENTION) & ~expository(s)),
        )
        .withColumn("terms_clause", F.col("leading_terms") & terms_clause(F.col("sentences")))
        .drop("evidence", "_telling", "_hints")
    )
    w = R.GATE_WEIGHTS
    confidence = F.least(
        F.lit(1.0),
        F.when(F.col("has_marker"), w["marker"]).otherwise(0.0)
        + F.when(F.col("data_practice"), w["practice"]).otherwise(0.0)
        + F.when(F.col("rights_or_retention"), w["rights"]).otherwise(0.0)
        + F.when(F.col("terms_clause"), w["terms"]).otherwise(0.0),
    )
    substantive = F.col("data_practice") | F.col("rights_or_retention") | F.col("terms_clause")
    status = (
        F.when(text == "", "empty")
        .when(substantive & (F.col("policy_confidence") >= R.GATE_THRESHOLD), "analyzed")
        .otherwise("not_policy")
    )
    return settle(step.withColumn("policy_confidence", confidence).withColumn("status", status))


# -- risks ------------------------------------------------------------------------------


def clause_hit(clause: Column, rule: R.RiskRule) -> Column:
    """Needs first, vetoes last: most clauses stop at the first words looked for."""
    hit = F.lit(True)
    for group in rule.needs:
        hit = hit & quick_any(clause["text"], clause["lowered"], group)
    return hit & ~matches_any(clause["text"], rule.vetoes) if rule.vetoes else hit


def document_hit(text: Column, lowered: Column, rule: R.RiskRule) -> Column:
    hit = quick_any(text, lowered, rule.needs[0])
    return hit & ~quick_any(text, lowered, rule.vetoes) if rule.vetoes else hit


# Words of which a rule needs one before anything else is looked at.
RISK_WORDS = {w for rule in R.RISK_RULES for w in words_of(rule.needs[0])}


def with_clauses(prepared: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Adds ``clauses`` of the sentences that hold a word of the rules (each with the 0-based position of its sentence),
    ``hints`` and ``lowered``; clauses and hints only where ``wanted``, if given.
    """

    def part(clause: Column, sentence: Column) -> Column:
        return F.struct(sentence.alias("sent_idx"), clause.alias("text"), F.lower(clause).alias("lowered"))

    telling = telling_sentences(RISK_WORDS, known_sentences(prepared))
    step = prepared.withColumn("_telling", telling if wanted is None else F.when(wanted, telling))
    per_sentence = F.transform("_telling", lambda t: F.transform(T.clauses(t["sentence"]), lambda c: part(c, t["sent_idx"])))
    step = step.withColumn("clauses", F.flatten(per_sentence)).withColumn("hints", hints_of(F.col("_telling")))
    return step.withColumn("lowered", F.lower("text")).drop("_telling")


def rule_evidence(rule: R.RiskRule) -> Column:
    """Evidence text of one rule from ``text``, ``sentences``, ``clauses`` and ``hints``; NULL when the rule does not fire."""
    possible = hinted(F.col("hints"), words_of(rule.needs[0]))
    if rule.scope == "clause":
        hits = F.filter("clauses", lambda c: clause_hit(c, rule))
        sentence = F.try_element_at(F.col("sentences"), F.try_element_at(hits, F.lit(1))["sent_idx"] + 1)
        return F.when(possible, T.excerpt(sentence, R.EVIDENCE_CHARS))
    shown = F.filter("sentences", lambda s: matches_any(s, rule.needs[0]))
    evidence = F.coalesce(F.try_element_at(shown, F.lit(1)), F.lit(""))
    return F.when(possible & document_hit(F.col("text"), F.col("lowered"), rule), T.excerpt(evidence, R.EVIDENCE_CHARS))


def with_risks(prepared: DataFrame, only: F.Column | None = None) -> DataFrame:
    """Adds ``risks``: (id, severity, evidence), most severe first, then in rule order.

    Rows where ``only`` is false get an empty array without running any clause rule.
    """
    wanted = F.lit(True) if only is None else only
    step = with_clauses(prepared.withColumn("_wanted", wanted), F.col("_wanted"))
    evidence = F.array(
        *[
            F.struct(
                F.lit(-R.SEVERITY_RANK[rule.severity]).alias("rank"),
                F.lit(pos).alias("pos"),
                F.lit(rule.id).alias("id"),
                F.lit(rule.severity).alias("severity"),
                F.when(F.col("_wanted"), rule_evidence(rule)).alias("evidence"),
            )
            for pos, rule in enumerate(R.RISK_RULES)
        ]
    )
    step = step.withColumn("risks", F.filter(evidence, lambda r: r["evidence"].isNotNull()))
    ordered = F.transform(
        F.array_sort("risks"),
        lambda r: F.struct(r["id"].alias("id"), r["severity"].alias("severity"), r["evidence"].alias("evidence")),
    )
    return step.withColumn("risks", ordered).drop("clauses", "hints", "lowered", "_wanted")


def risk_rows(policies: DataFrame, rule_id: str, key: str = "doc_id") -> DataFrame:
    """Documents that show one risk, with its evidence: (key, severity, evidence)."""
    rule = RULES[rule_id]
    prepared = with_sentences(with_text(policies.select(key, "body")))
    prepared = with_clauses(prepared)
    found = prepared.select(key, F.lit(rule.severity).alias("severity"), rule_evidence(rule).alias("evidence"))
    return settle(found).filter(F.col("evidence").isNotNull())


def severity_points(risks: Column) -> Column:
    def points(severity: Column) -> Column:
        chain = F.lit(0)
        for name, value in R.SEVERITY_POINTS.items():
            chain = F.when(severity == name, F.lit(value)).otherwise(chain)
        return chain

    return F.aggregate(risks, F.lit(0), lambda total, r: total + points(r["severity"]))


def risk_score(risks: Column, categories: Column) -> Column:
    return F.least(F.lit(100), severity_points(risks) + F.least(F.size(categories) * 4, F.lit(24)))


def risk_level(score: Column, risks: Column) -> Column:
    high = F.size(F.filter(risks, lambda r: r["severity"] == "high"))
    return (
        F.when((score >= 60) | (high >= 2), "high").when((score >= 35) | (high > 0), "medium").otherwise("low")
    )


def positives(text: Column) -> Column:
    def found(s: Column) -> Column:
        return F.array(
            *[F.when(quick_any(s["text"], s["lowered"], patterns), F.lit(name)) for name, patterns in R.POSITIVE_RULES]
        )

    return F.array_compact(let(with_lower(text), found))


# -- the whole analysis -----------------------------------------------------------------


def analyze(
    policies: DataFrame,
    key: str = "doc_id",
    max_chars: int | None = None,
    extend: Callable[[DataFrame], DataFrame] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One result row per document.  Text that is no policy gets a NULL score and no risks.

    ``extend`` may add columns worked out from ``text`` in the same pass; ``keep`` names those to return.
    """
    prepared = with_sentences(with_text(policies.select(key, "body"), max_chars=max_chars))
    gated = with_gate(prepared.withColumn("_known", telling_sentences(GATE_WORDS | RISK_WORDS)))
    gated = extend(gated) if extend else gated
    analyzed = F.col("status") == "analyzed"
    scored = with_risks(gated, analyzed)
    scored = scored.withColumn(
        "data_categories",
        F.when(analyzed, T.data_categories(T.tokens(F.col("text")))).otherwise(F.array().cast("array<struct<id:string,matched:array<string>>>")),
    ).withColumn("positives", F.when(analyzed, positives(F.col("text"))).otherwise(F.array().cast("array<string>")))
    scored = scored.withColumn(
        "score", F.when(analyzed, risk_score(F.col("risks"), F.col("data_categories")))
    )
    return scored.select(
        key,
        "status",
        F.when(F.col("status") != "empty", F.col("policy_confidence")).alias("policy_confidence"),
        T.word_count(F.col("text")).alias("word_count"),
        "score",
        F.when(analyzed, risk_level(F.col("score"), F.col("risks"))).otherwise("unknown").alias("level"),
        F.when(analyzed, FN.max_severity(F.transform("risks", lambda r: r["severity"]))).alias("overall_severity"),
        "data_categories",
        "risks",
        "positives",
        *keep,
    )
