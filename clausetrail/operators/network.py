"""Requests of a page against what its policy discloses.

Requests are first reduced to one row per (tab, host, path); that step aggregates before it
shuffles, so a tab or a tracker with a third of all requests costs no more than a quiet one.
Everything after it works on those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from clausetrail import rules as R
from clausetrail.functions import findings as FN
from clausetrail.functions import text as T
from clausetrail.functions import urls as U
from clausetrail.functions.patterns import matches_any
from clausetrail.operators import hosts as H
from clausetrail.operators import sections as S
from clausetrail.operators import vendors as V

WRITES = ("POST", "PUT", "PATCH")


def sensitive_category(tokens: Column, category: str) -> Column:
    patterns = dict(R.SENSITIVE_FIELDS)[category]
    return (tokens != "") & matches_any(tokens, patterns)


def pages_with_policy(sites: DataFrame, facts: DataFrame, host_facts: DataFrame) -> DataFrame:
    """One row per tab: its host and what its policy says, the named domains reduced to sites and parents.

    A page without a captured policy stays: nothing is found, named or mentioned there.  Such pages have no document to
    be dealt by and would all go to one task, so the join has a second key that spreads them.
    """
    wanted = facts.join(sites.select("doc_id").distinct(), "doc_id", "left_semi")
    named = wanted.select("doc_id", F.explode("policy_domains").alias("host"))
    domain_sites = H.with_host_facts(named, host_facts).groupBy("doc_id").agg(F.collect_set("registrable").alias("policy_sites"))
    parents = F.array_distinct(F.flatten(F.transform("policy_domains", U.host_suffixes)))
    policies = (
        wanted.withColumn("policy_parents", parents)
        .join(domain_sites, "doc_id", "left")
        .withColumn("policy_sites", F.coalesce("policy_sites", F.array().cast("array<string>")))
    )
    page_site = host_facts.select(F.col("host").alias("page_host"), F.col("registrable").alias("page_site"))
    pages = with_document(sites.join(page_site, "page_host", "left"), policies)
    for field in policies.schema:
        if isinstance(field.dataType, ArrayType):
            pages = pages.withColumn(field.name, F.coalesce(field.name, F.array().cast(field.dataType)))
        elif isinstance(field.dataType, BooleanType):
            pages = pages.withColumn(field.name, F.coalesce(field.name, F.lit(False)))
    return pages


def with_document(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages with the columns of their document; pages without one are spread by their tab."""
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("tab_id"), F.lit(1 << 16))).otherwise(F.lit(0).cast("bigint"))
    keyed = documents.withColumn("_spread", F.lit(0).cast("bigint"))
    return pages.withColumn("_spread", spread).join(keyed.hint("merge"), ["doc_id", "_spread"], "left").drop("_spread")


def all_hosts(requests: DataFrame, sites: DataFrame, facts: DataFrame, cookies: DataFrame | None = None) -> DataFrame:
    """Every host that needs a site: requested, visited, named in a policy, set by a cookie."""
    hosts = requests.select("host").unionByName(sites.select(F.col("page_host").alias("host")))
    hosts = hosts.unionByName(facts.select(F.explode("policy_domains").alias("host")))
    if cookies is not None:
        from clausetrail.operators.cookies import bare_domain

        hosts = hosts.unionByName(cookies.select(bare_domain(F.col("domain")).alias("host")))
    return hosts


def host_paths(requests: DataFrame) -> DataFrame:
    """One row per (tab, host, path) with first sight and what happened there."""
    order = F.struct("ts", "request_id")
    return requests.groupBy("tab_id", "host", "path").agg(
        F.count("*").alias("n"),
        F.min(order).alias("first"),
        F.bool_or(F.col("method").isin(*WRITES)).alias("writes"),
        F.min(F.when(F.col("method").isin(*WRITES), order)).alias("first_write"),
        F.min(F.when(F.col("scheme") == "http", order)).alias("first_insecure"),
    )


def tab_hosts(requests: DataFrame, pages: DataFrame, host_facts: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per (tab, host): whose it is, whether it tracks, and its preferred vendor.

    The vendor is that of the first request a rule knows, else unknown.
    """
    seen = host_paths(requests)
    vendors = V.classify(seen, rules)
    facts = H.with_host_facts(seen, host_facts).join(vendors, ["host", "path"])
    tracks = F.col("tracker_domain") | U.tracker_tokens(H.without_dots(F.col("host")), F.col("path"))
    unknown = F.col("vendor.vendor") == R.UNKNOWN_VENDOR[0]
    rows = facts.groupBy("tab_id", "host").agg(
        F.sum("n").alias("n"),
        F.min("first").alias("first"),
        F.first("registrable").alias("registrable"),
        F.min(F.when(tracks, F.col("first"))).alias("first_tracked"),
        F.sum(F.when(tracks, F.col("n")).otherwise(0)).alias("tracker_requests"),
        F.min("first_write").alias("first_write"),
        F.min("first_insecure").alias("first_insecure"),
        F.min_by(F.struct("vendor", "first", "path"), F.struct(unknown, F.col("first"))).alias("preferred"),
    )
    bare = F.regexp_replace(H.without_dots(F.col("host")), r"^www\.", "")
    # The vendor a policy may name is told from the host alone.
    by_host = V.classify(rows.select(bare.alias("host"), F.lit("/").alias("path")), rules)
    by_host = by_host.select(F.col("host").alias("bare_host"), F.col("vendor.vendor").alias("host_vendor"))
    page = pages.select(
        "tab_id", "page_site", "policy_domains", "policy_parents", "policy_sites", "named_vendors", "found_sections"
    )
    # A small file of pages unfolds to many times its size, so pages meet their rows by merge joins here and elsewhere.
    joined = rows.withColumn("bare_host", bare).join(by_host, "bare_host").join(page.hint("merge"), "tab_id")
    third = F.coalesce(F.col("page_site") != F.col("registrable"), F.lit(False))
    disclosed = (
        F.arrays_overlap(U.host_suffixes(F.col("bare_host")), "policy_domains")
        | F.array_contains("policy_parents", F.col("bare_host"))
        | F.array_contains("policy_sites", F.col("registrable"))
        | F.array_contains("named_vendors", F.col("host_vendor"))
    )
    return joined.select(
        "tab_id",
        "host",
        "n",
        "first",
        third.alias("third_party"),
        "first_tracked",
        "tracker_requests",
        "first_write",
        "first_insecure",
        F.col("preferred.vendor.vendor").alias("vendor"),
        F.col("preferred.vendor.category").alias("category"),
        F.col("preferred.vendor.risk").alias("risk"),
        F.col("preferred.vendor.expected").alias("expected"),
        F.col("preferred.first").alias("preferred_first"),
        F.array_except("preferred.vendor.expected", "found_sections").alias("missing"),
        disclosed.alias("disclosed"),
    )


def vendor_summary(hosts: DataFrame) -> DataFrame:
    """Third-party hosts with vendor, expected and missing policy sections."""
    return hosts.filter("third_party").select("tab_id", "host", "vendor", "category", "risk", "expected", "missing", "preferred_first")


def key_rows(requests: DataFrame) -> DataFrame:
    """Distinct query keys per tab in order of first use: (tab_id, key, first)."""
    rows = requests.select("tab_id", "ts", "request_id", F.posexplode("query_keys").alias("pos", "key"))
    return rows.groupBy("tab_id", "key").agg(F.min(F.struct("ts", "request_id", "pos")).alias("first"))


def classified_keys(keys: DataFrame, *order: str) -> DataFrame:
    """(tab_id, category, keys): at most eight keys per sensitive category, in the given order."""
    tokens = T.tokens(F.col("key"))
    hits = F.array_compact(
        F.array(
            *[
                F.when(sensitive_category(F.col("tokens"), name), F.struct(F.lit(i).alias("cat_ord"), F.lit(name).alias("category")))
                for i, (name, _) in enumerate(R.SENSITIVE_FIELDS)
            ]
        )
    )
    rows = keys.withColumn("tokens", tokens).select("tab_id", "key", *order, F.inline(hits))
    # The group limit keeps the first keys before anything is gathered.
    place = F.row_number().over(Window.partitionBy("tab_id", "category", "cat_ord").orderBy(*order, "key"))
    rows = rows.withColumn("place", place).filter(F.col("place") <= R.KEYS_PER_CATEGORY)
    placed = F.struct("place", "key")
    grouped = rows.groupBy("tab_id", "category", "cat_ord").agg(F.array_sort(F.collect_list(placed)).alias("keys"))
    return grouped.withColumn("keys", F.transform("keys", lambda k: k["key"]))


def _hosts_where(when: Column, first: Column) -> Column:
    """All hosts of a tab that meet a condition, in order of first sight."""
    picked = F.array_sort(F.collect_list(F.when(when, F.struct(first.alias("first"), F.col("host").alias("host")))))
    return F.transform(picked, lambda h: h["host"])


def first_hosts(hosts: DataFrame, lists: dict[str, tuple[Column, Column, int]]) -> DataFrame:
    """tab_id and, for each list (condition, order, limit), its first hosts; ranked before anything is gathered."""
    most = max(limit for _, _, limit in lists.values())
    entries = [F.when(when, F.struct(F.lit(name).alias("list"), F.lit(limit).alias("limit"), first.alias("first"))) for name, (when, first, limit) in lists.items()]
    rows = hosts.select("tab_id", "host", F.inline(F.array_compact(F.array(*entries))))
    place = F.row_number().over(Window.partitionBy("tab_id", "list").orderBy("first", "host"))
    # A fixed bound first, which Spark applies ahead of the shuffle.
    kept = rows.withColumn("place", place).filter(F.col("place") <= most).filter(F.col("place") <= F.col("limit"))

    def own(name: str) -> Column:
        placed = F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("place", "host"))))
        return F.transform(placed, lambda h: h["host"]).alias(name)

    return kept.groupBy("tab_id").agg(*[own(name) for name in lists])


def analyze(requests: DataFrame, pages: DataFrame, hosts: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per tab: counts, host lists, vendor summary, sensitive keys and findings."""
    gap = F.col("third_party") & (F.size("missing") > 0) & (F.col("category") != "cdn_security")
    serious = F.col("category").isin("advertising", "analytics", "payment")
    vendor = F.struct("host", "vendor", "category", "risk", "expected", "missing")
    per_tab = hosts.groupBy("tab_id").agg(
        F.sum("n").alias("request_count"),
        _hosts_where(F.col("third_party"), F.col("first")).alias("third_party_hosts"),
        _hosts_where(F.col("first_tracked").isNotNull(), F.col("first_tracked")).alias("tracker_hosts"),
        F.bool_or(gap & serious).alias("serious_gap"),
        F.array_sort(F.collect_list(F.when(F.col("third_party"), F.struct(F.col("first").alias("first"), vendor.alias("v"))))).alias("vendors"),
    )
    limited = first_hosts(
        hosts,
        {
            "undisclosed": (F.col("third_party") & ~F.col("disclosed"), F.col("first"), 8),
            "posted": (F.col("third_party") & F.col("first_write").isNotNull(), F.col("first_write"), 8),
            "insecure": (F.col("first_insecure").isNotNull(), F.col("first_insecure"), 6),
            "gaps": (gap, F.col("first"), 6),
            "trackers": (F.col("first_tracked").isNotNull(), F.col("first_tracked"), 8),
        },
    )
    per_key = keys.groupBy("tab_id").agg(
        F.array_sort(F.collect_list(F.struct("cat_ord", "category", "keys"))).alias("sensitive_fields")
    )
    facts = pages.select("tab_id", "found_sections", "disclosed", "mentions_advertising")
    joined = facts.join(per_tab, "tab_id", "left").join(limited, "tab_id", "left").join(per_key, "tab_id", "left")
    none = F.array().cast("array<string>")
    for name in ("third_party_hosts", "tracker_hosts", "undisclosed", "posted", "insecure", "gaps", "trackers"):
        joined = joined.withColumn(name, F.coalesce(name, none))
    fields = F.coalesce("sensitive_fields", F.array().cast("array<struct<cat_ord:int,category:string,keys:array<string>>>"))
    joined = joined.withColumn("sensitive_fields", fields)
    hidden_fields = F.filter("sensitive_fields", lambda f: ~F.array_contains(F.col("disclosed"), f["category"]))
    quiet = ~S.has(F.col("found_sections"), "cookies_tracking") & ~F.col("mentions_advertising")
    found = FN.findings(
        FN.finding(F.size("undisclosed") > 0, "undisclosed_third_parties", "high", F.col("undisclosed")),
        FN.finding(F.size("gaps") > 0, "vendor_policy_section_gap", F.when(F.col("serious_gap"), "high").otherwise("medium"), F.col("gaps")),
        FN.finding((F.size("tracker_hosts") > 0) & quiet, "tracker_without_disclosure", "high", F.col("trackers")),
        FN.finding(
            F.size(hidden_fields) > 0, "sensitive_fields_without_category", "medium", F.transform(hidden_fields, lambda f: f["category"])
        ),
        FN.finding(F.size("posted") > 0, "third_party_post", "medium", F.col("posted")),
        FN.finding(F.size("insecure") > 0, "insecure_http", "high", F.col("insecure")),
    )
    return joined.select(
        "tab_id",
        F.coalesce("request_count", F.lit(0)).alias("request_count"),
        "third_party_hosts",
        "tracker_hosts",
        F.coalesce(F.transform("vendors", lambda v: v["v"]), F.array().cast(_vendor_type())).alias("vendor_summary"),
        "sensitive_fields",
        "undisclosed",
        "gaps",
        found.alias("findings"),
    )


def _vendor_type() -> str:
    return "array<struct<host:string,vendor:string,category:string,risk:string,expected:array<string>,missing:array<string>>>"


def host_country_signals(result: DataFrame, sites: DataFrame) -> DataFrame:
    """Overseas transfer of a tab, from the countries of page and third-party hosts: detected, not_detected or unknown."""
    given = F.upper(F.coalesce("country_code", F.lit("")))
    source = F.when(given.rlike("^[A-Z]{2}$"), given).otherwise(U.country_of(F.col("page_host")))
    joined = result.select("tab_id", "third_party_hosts").join(sites.select("tab_id", source.alias("source")).hint("merge"), "tab_id")
    countries = F.array_compact(F.transform("third_party_hosts", U.country_of))
    joined = joined.withColumn("countries", countries)
    status = (
        F.when(F.col("source").isNull() | (F.size("countries") == 0), "unknown")
        .when(F.exists("countries", lambda c: c != F.col("source")), "detected")
        .when(F.size("countries") != F.size("third_party_hosts"), "unknown")
        .otherwise("not_detected")
    )
    return joined.select("tab_id", "source", status.alias("overseas_status"))


