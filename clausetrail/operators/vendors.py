"""Vendors behind request hosts, with rules users may add to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions import urls as U
from clausetrail.functions.patterns import matches, text_list
from clausetrail.operators.hosts import small_table


def clean_custom_rules(rules: DataFrame, max_rules: int | None = None, max_patterns: int | None = None) -> DataFrame:
    """Valid user rules: trimmed, known categories and sections, one per id, first ones kept.

    Input: (id, vendor, patterns, category, risk, expected_sections, position).  Rules at the same position
    go by id, and rows of one id at the same position by their content.
    """

    def domain(pattern: Column) -> Column:
        text = F.lower(F.trim(pattern))
        named = F.when(text.rlike("^https?://"), U.parts(text)["host"]).otherwise(text)
        return F.when(F.length(text) <= 253, F.regexp_replace(F.regexp_replace(named, r"^\.", ""), r"\.\z", ""))

    patterns = F.filter(F.transform("patterns", domain), lambda p: F.coalesce(p != "", F.lit(False)))
    sections = F.filter(F.transform("expected_sections", F.trim), lambda s: s.isin(R.CUSTOM_SECTIONS))
    cleaned = rules.select(
        F.substring("id", 1, 128).alias("id"),
        F.substring(F.trim("vendor"), 1, 120).alias("vendor"),
        (F.slice(F.array_distinct(patterns), 1, max_patterns) if max_patterns else F.array_distinct(patterns)).alias("patterns"),
        F.when(F.trim("category").isin(R.CUSTOM_CATEGORIES), F.trim("category")).otherwise("unknown").alias("category"),
        F.when(F.trim("risk").isin(R.CUSTOM_RISKS), F.trim("risk")).otherwise("unknown").alias("risk"),
        F.array_distinct(sections).alias("expected_sections"),
        "position",
    )
    valid = cleaned.filter(
        (F.col("vendor") != "")
        & (F.size("patterns") > 0)
        & F.forall("patterns", lambda p: matches(p, R.CUSTOM_PATTERN, False))
        & (F.size("expected_sections") > 0)
    )
    content = [c for c in valid.columns if c not in ("id", "position")]
    first = valid.groupBy("id").agg(F.min(F.struct("position", *content)).alias("r"))
    kept = first.select("id", *[f"r.{c}" for c in (*content, "position")])
    return kept.orderBy("position", "id").limit(max_rules) if max_rules else kept


def vendor_rules(spark: SparkSession, custom: DataFrame | None = None) -> DataFrame:
    """One row per host pattern in match order; user rules come before the built-in ones."""
    built_in = small_table(
        spark,
        [(i, v, p, c, r, s) for i, (v, p, c, r, s) in enumerate(R.VENDOR_RULES)],
        "rule_ord bigint, vendor string, patterns array<string>, category string, risk string, expected array<string>",
    )
    built_in = built_in.withColumn("rule_ord", F.struct(F.lit(1).alias("source"), F.col("rule_ord").alias("position"), F.lit("").alias("id")))
    rules = built_in
    if custom is not None:
        own = clean_custom_rules(custom).select(
            F.struct(F.lit(0).alias("source"), F.col("position").cast("bigint").alias("position"), "id").alias("rule_ord"),
            "vendor",
            "patterns",
            "category",
            "risk",
            F.col("expected_sections").alias("expected"),
        )
        rules = own.unionByName(built_in)
    pattern = F.regexp_replace(F.col("pattern"), r"^(https?://)?(\*\.)?", "")
    host = F.regexp_replace(F.split_part(pattern, F.lit("/"), F.lit(1)), r"^www\.", "")
    path = F.regexp_extract(pattern, "(/.+)$", 1)
    return rules.withColumn("pattern", F.explode("patterns")).select(
        host.alias("suffix"), path.alias("rule_path"), "rule_ord", F.struct("vendor", "category", "risk", "expected").alias("vendor")
    )


def classify(targets: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Adds ``vendor`` (vendor, category, risk, expected) to distinct (host, path) targets.

    Each parent of the host looks for rules by equality; the earliest matching rule wins.
    The built-in rules come marked for broadcast; a table of user rules is left to the planner.
    """
    unique = targets.select(host, path).distinct()
    bare = F.regexp_replace(F.lower(host), r"^www\.", "")
    looked_up = unique.withColumn("suffix", F.explode(U.host_suffixes(bare))).join(rules, "suffix", "left")
    fits = (F.col("rule_path") == "") | (F.col(path) == F.col("rule_path")) | F.startswith(path, F.concat("rule_path", F.lit("/")))
    best = looked_up.groupBy(host, path).agg(F.min_by("vendor", F.when(fits, F.col("rule_ord"))).alias("vendor"))
    name, category, risk, expected = R.UNKNOWN_VENDOR
    unknown = F.struct(
        F.lit(name).alias("vendor"), F.lit(category).alias("category"), F.lit(risk).alias("risk"), text_list(expected).alias("expected")
    )
    return best.withColumn("vendor", F.coalesce("vendor", unknown))
