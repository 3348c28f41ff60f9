"""Form fields, storage keys and cookies of a page against what its policy discloses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions import findings as FN
from clausetrail.functions import text as T
from clausetrail.functions import urls as U
from clausetrail.operators import hosts as H
from clausetrail.operators import sections as S
from clausetrail.operators.cookies import bare_domain
from clausetrail.operators.network import sensitive_category

DESCRIPTOR = ("name", "id", "autocomplete", "placeholder", "label", "type")


def answer_fields(fields: DataFrame, per_page: int | None = None) -> DataFrame:
    """Fields that hold an answer; the first ``per_page`` of each page where a limit is given."""
    kept = fields.filter(~F.coalesce("type", F.lit("")).isin(R.SKIPPED_FIELD_TYPES))
    if per_page is None:
        return kept
    place = F.row_number().over(Window.partitionBy("tab_id").orderBy("field_id"))
    return kept.withColumn("place", place).filter(F.col("place") <= per_page).drop("place")


def descriptor(fields: DataFrame) -> Column:
    parts = [F.when(F.col(c) != "", F.col(c)) for c in DESCRIPTOR if c in fields.columns]
    return F.concat_ws(" ", *parts)


def classify_fields(fields: DataFrame) -> DataFrame:
    """Adds ``category``: the first sensitive category of the field's words, NULL when there is none."""
    step = fields.withColumn("tokens", T.tokens(descriptor(fields)))
    category = F.coalesce(*[F.when(sensitive_category(F.col("tokens"), name), name) for name, _ in R.SENSITIVE_FIELDS])
    return step.withColumn("category", category).drop("tokens")


def field_name() -> Column:
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("name", "label", "type")])


def analyze_forms(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per tab: field counts, categories and findings."""
    order = F.struct("field_id", field_name().alias("name"))
    cat_ord = F.create_map(*[x for i, (name, _) in enumerate(R.SENSITIVE_FIELDS) for x in (F.lit(name), F.lit(i))])
    # Only the first five names of a category are shown, so only those are gathered.
    first = Window.partitionBy("tab_id", "category").orderBy("field_id")
    shown = fields.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= 5)
    names = shown.groupBy("tab_id", "category").agg(F.transform(F.array_sort(F.collect_list(order)), lambda f: f["name"]).alias("names"))
    counts = fields.groupBy("tab_id", "category").agg(F.count("*").alias("n"), F.count_if("required").alias("required"))
    same = (F.col("c.tab_id") == F.col("s.tab_id")) & F.col("c.category").eqNullSafe(F.col("s.category"))
    by_category = (
        counts.alias("c").join(names.alias("s"), same).select("c.*", "s.names")
        .withColumn("cat_ord", F.element_at(cat_ord, F.col("category")))
    )
    sensitive = F.col("category").isNotNull()
    per_tab = by_category.groupBy("tab_id").agg(
        F.sum("n").alias("field_count"),
        F.coalesce(F.sum(F.when(sensitive, F.col("n"))), F.lit(0)).alias("sensitive_count"),
        F.coalesce(F.sum(F.when(sensitive, F.col("required"))), F.lit(0)).alias("required_count"),
        F.array_sort(F.collect_list(F.when(sensitive, F.struct("cat_ord", "category", "n", "required", "names")))).alias("categories"),
    )
    joined = pages.select("tab_id", "disclosed").join(per_tab, "tab_id", "left")
    categories = F.coalesce("categories", F.array().cast("array<struct<cat_ord:int,category:string,n:bigint,required:bigint,names:array<string>>>"))
    joined = joined.withColumn("categories", categories)
    hidden = F.transform(
        F.filter("categories", lambda c: ~F.array_contains(F.col("disclosed"), c["category"])), lambda c: c["category"]
    )
    found = FN.findings(
        FN.finding(F.size(hidden) > 0, "form_fields_without_policy_category", "high", hidden),
        FN.finding(F.col("required_count") >= 4, "many_required_sensitive_fields", "medium"),
    )
    zero = F.lit(0)
    return joined.select(
        "tab_id",
        F.coalesce("field_count", zero).alias("field_count"),
        F.coalesce("sensitive_count", zero).alias("sensitive_count"),
        F.coalesce("required_count", zero).alias("required_count"),
        "categories",
        found.alias("findings"),
    )


def storage_keys(keys: DataFrame) -> DataFrame:
    """Distinct keys of each area: (tab_id, area, key)."""
    return keys.select("tab_id", "area", F.col("storage_key").alias("key")).distinct()


def weak(secure: Column, same_site: Column) -> Column:
    return ~F.coalesce(secure, F.lit(False)) | F.coalesce(same_site == "no_restriction", F.lit(False))


def cookie_flags(cookies: DataFrame, pages: DataFrame, host_facts: DataFrame) -> DataFrame:
    """Active cookies with what is noteworthy about them: tracking, third party, weakly protected."""
    active = cookies.filter(~F.col("removed")).withColumn("cookie_host", bare_domain(F.col("domain")))
    placed = H.with_host_facts(active, host_facts.select("host", "registrable"), "cookie_host")
    joined = placed.join(pages.select("tab_id", "page_site").hint("merge"), "tab_id")
    return joined.select(
        "tab_id",
        "identity",
        "change_id",
        "name",
        "domain",
        U.tracking_cookie(F.col("name")).alias("tracking"),
        F.coalesce((F.col("cookie_host") != "") & (F.col("page_site") != F.col("registrable")), F.lit(False)).alias("third_party"),
        weak(F.col("secure"), F.col("same_site")).alias("weak"),
    )


def _cookies_where(when: Column, label: Column) -> Column:
    """The first eight cookies of a tab that meet a condition, in order of their last change.

    ``place`` columns number them, so lists hold eight entries for a tab of any size.
    """
    picked = F.array_sort(F.collect_list(F.when(when, F.struct(F.col("change_id").alias("change_id"), label.alias("label")))))
    return F.transform(picked, lambda c: c["label"])


def _place(flag: str) -> Column:
    return F.row_number().over(Window.partitionBy("tab_id", flag).orderBy("change_id"))


def analyze_storage(classified: DataFrame, keys: DataFrame, cookies: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per tab from classified keys, all keys and flagged cookies."""
    counts = keys.groupBy("tab_id").agg(
        F.count_if(F.col("area") == "local").alias("local_keys"), F.count_if(F.col("area") == "session").alias("session_keys")
    )
    areas = classified.groupBy("tab_id").agg(F.array_sort(F.collect_list(F.struct("cat_ord", "category", "keys"))).alias("classified"))
    named = F.concat(F.col("name"), F.lit(" ("), F.col("domain"), F.lit(")"))
    for flag in ("tracking", "third_party", "weak"):
        cookies = cookies.withColumn(f"{flag}_place", _place(flag))
    listed = lambda flag: F.col(flag) & (F.col(f"{flag}_place") <= 8)
    jar = cookies.groupBy("tab_id").agg(
        F.count("*").alias("cookie_count"),
        F.count_if("third_party").alias("third_party_cookies"),
        _cookies_where(listed("tracking"), named).alias("tracking_names"),
        _cookies_where(listed("third_party"), named).alias("third_names"),
        _cookies_where(listed("weak"), F.col("name")).alias("weak_names"),
    )
    facts = pages.select("tab_id", "found_sections", "mentions_storage", "mentions_advertising", "mentions_third_party")
    joined = facts.join(counts, "tab_id", "left").join(areas, "tab_id", "left").join(jar, "tab_id", "left")
    none = F.array().cast("array<string>")
    for name in ("tracking_names", "third_names", "weak_names"):
        joined = joined.withColumn(name, F.coalesce(name, none))
    empty = F.array().cast("array<struct<cat_ord:int,category:string,keys:array<string>>>")
    joined = joined.withColumn("classified", F.coalesce("classified", empty))
    silent = ~S.has(F.col("found_sections"), "cookies_tracking")
    found = FN.findings(
        FN.finding(
            (F.size("classified") > 0) & silent & ~F.col("mentions_storage"),
            "storage_without_disclosure",
            "medium",
            F.transform("classified", lambda c: c["category"]),
        ),
        FN.finding(
            (F.size("tracking_names") > 0) & silent & ~F.col("mentions_advertising"),
            "tracking_cookie_without_disclosure",
            "high",
            F.col("tracking_names"),
        ),
        FN.finding(
            (F.size("third_names") > 0) & ~F.col("mentions_third_party"), "third_party_cookie_without_disclosure", "medium", F.col("third_names")
        ),
        FN.finding(F.size("weak_names") > 0, "weak_cookie_security", "medium", F.col("weak_names")),
    )
    zero = F.lit(0)
    return joined.select(
        "tab_id",
        F.coalesce("local_keys", zero).alias("local_keys"),
        F.coalesce("session_keys", zero).alias("session_keys"),
        F.coalesce("cookie_count", zero).alias("cookie_count"),
        F.coalesce("third_party_cookies", zero).alias("third_party_cookies"),
        "classified",
        found.alias("findings"),
    )
