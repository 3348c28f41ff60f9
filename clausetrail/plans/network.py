"""Queries on URLs, sites, vendors, requests, forms and storage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions import findings as FN
from clausetrail.functions import urls as U
from clausetrail.functions.patterns import let
from clausetrail.operators import cookies as K
from clausetrail.operators import forms_storage as FS
from clausetrail.operators import hosts as H
from clausetrail.operators import network as N
from clausetrail.operators import requests as RQ
from clausetrail.operators import vendors as V
from clausetrail.operators.consent import looks_like_banner
from clausetrail.plans.inputs import inputs
from clausetrail.plans.registry import query
from clausetrail.sources import documents as D


def joined(column: str | Column) -> Column:
    return F.array_join(column, "|")


@query("src_2_document_admission")
def _(spark, sf_dir):
    return D.admit(inputs(spark, sf_dir).view("fx_fetches")).select("fetch_id", "url", "category")


@query("src_2_admission_funnel")
def _(spark, sf_dir):
    return D.admission_funnel(inputs(spark, sf_dir).view("fx_fetches"))


@query("src_3_content_gate")
def _(spark, sf_dir):
    fetches = inputs(spark, sf_dir).view("fx_fetches")
    allowed = D.mime_type(F.col("content_type")).isin(R.POLICY_CONTENT_TYPES) & (F.octet_length("body") <= R.MAX_POLICY_BYTES)
    return fetches.select("fetch_id", D.mime_type(F.col("content_type")).alias("mime_type"), allowed.alias("allowed"))


@query("src_4_secret_query_keys")
def _(spark, sf_dir):
    requests = inputs(spark, sf_dir).view("fx_requests")
    secret = let(U.parts(F.col("url")), lambda p: U.sensitive_query(p["query"]))
    return requests.select("request_id", secret.alias("secret"))


@query("src_5_public_hosts")
def _(spark, sf_dir):
    x = inputs(spark, sf_dir)
    fetched = x.view("fx_fetches").select(let(U.parts(F.col("url")), lambda p: p["host"]).alias("host"))
    hosts = fetched.unionByName(x.view("fx_requests").select("host")).filter(F.col("host") != "").distinct()
    return hosts.select("host", U.private_host(F.col("host")).alias("private"))


@query("src_6_error_categories")
def _(spark, sf_dir):
    checks = inputs(spark, sf_dir).view("fx_checks").filter(~F.col("ok"))
    return checks.select("check_id", D.error_category(F.col("error_message")).alias("category"))


@query("src_7_minimised_requests")
def _(spark, sf_dir):
    requests = inputs(spark, sf_dir).requests
    return requests.select(
        "request_id", "tab_id", "ts", "url", "host", "path", "scheme", "method", "resource_type", joined("query_keys").alias("query_keys")
    )


@query("src_8_cookie_changes")
def _(spark, sf_dir):
    changes = inputs(spark, sf_dir).changes
    return changes.select("change_id", "tab_id", "ts", "name", "domain", "removed", "partition")


@query("src_10_form_fields")
def _(spark, sf_dir):
    fields = FS.answer_fields(inputs(spark, sf_dir).view("fx_form_fields"))
    return fields.select("field_id", "tab_id", "name", "type")


@query("txt_14_readable_candidate")
def _(spark, sf_dir):
    from clausetrail.operators.pages import best_candidate

    return best_candidate(inputs(spark, sf_dir).view("fx_candidates"))


@query("url_1_minimised_urls")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).requests.select("request_id", "url", "scheme", "host")


@query("url_2_minimised_paths")
def _(spark, sf_dir):
    requests = inputs(spark, sf_dir).view("fx_requests")
    return requests.groupBy("path").agg(F.count("*").alias("n")).withColumn("minimised", U.minimal_path(F.col("path")))


@query("url_3_field_keys")
def _(spark, sf_dir):
    keys = inputs(spark, sf_dir).view("fx_requests").groupBy("tab_id").agg(F.array_sort(F.collect_set("query_key")).alias("keys"))
    return keys.select("tab_id", joined(U.field_keys(F.col("keys"))).alias("keys"))


@query("url_4_masked_identifiers")
def _(spark, sf_dir):
    keys = inputs(spark, sf_dir).view("fx_requests").groupBy("query_key").agg(F.count("*").alias("n"))
    return keys.withColumn("masked", U.masked_name(F.col("query_key")))


@query("url_5_masked_cookie_names")
def _(spark, sf_dir):
    names = inputs(spark, sf_dir).view("fx_cookie_changes").groupBy("name").agg(F.count("*").alias("n"))
    family = F.coalesce(U.tracking_family(F.col("name")), F.lit(""))
    return names.select("name", "n", family.alias("family"), U.masked_name(F.col("name")).alias("masked"))


@query("url_6_registrable_domains")
def _(spark, sf_dir):
    x = inputs(spark, sf_dir)
    hosts = x.view("fx_requests").select("host").unionByName(x.sites.select(F.col("page_host").alias("host")))
    return H.host_dimension(hosts, x.suffixes).select("host", "registrable")


@query("url_7_third_party_requests")
def _(spark, sf_dir):
    x = inputs(spark, sf_dir)
    hosts = x.view("fx_requests").select("host").unionByName(x.sites.select(F.col("page_host").alias("host")))
    facts = H.host_dimension(hosts, x.suffixes).select("host", "registrable")
    pages = H.with_host_facts(x.sites.select("tab_id", "page_host"), facts, "page_host", "page_")
    # Per (tab, host) first: the join sees each pair once, however many requests it stands for.
    pairs = x.view("fx_requests").groupBy("tab_id", "host").agg(F.count("*").alias("n"))
    placed = H.with_host_facts(pairs, facts).join(pages, "tab_id")
    return placed.select("tab_id", "host", "n", (F.col("registrable") != F.col("page_registrable")).alias("third_party"))


@query("url_8_vendors")
def _(spark, sf_dir):
    x = inputs(spark, sf_dir)
    found = V.classify(x.requests, x.rules)
    return found.select("host", "path", "vendor.vendor", "vendor.category", "vendor.risk", joined("vendor.expected").alias("expected"))


def custom_rules(spark, sf_dir):
    """User rules derived from the hosts seen in requests: one good rule per host and some that must be dropped."""
    hosts = inputs(spark, sf_dir).view("fx_requests").select("host").distinct()
    usable = F.endswith("host", F.lit(".net")) | F.endswith("host", F.lit(".test"))
    return hosts.filter(usable).select(
        F.concat(F.lit("own-"), "host").alias("id"),
        F.concat(F.lit("  Own "), "host").alias("vendor"),
        F.array(F.upper("host"), F.col("host"), F.lit(" ")).alias("patterns"),
        F.when(F.endswith("host", F.lit(".test")), "advertising").otherwise("nonsense").alias("category"),
        F.lit("tracking").alias("risk"),
        F.when(F.startswith("host", F.lit("cdn.")), F.array(F.lit("unheard_of"))).otherwise(F.array(F.lit("purpose"), F.lit("security"))).alias("expected_sections"),
        F.length("host").cast("bigint").alias("position"),
    )


@query("url_9_custom_vendor_rules")
def _(spark, sf_dir):
    cleaned = V.clean_custom_rules(custom_rules(spark, sf_dir))
    return cleaned.select("id", "vendor", joined("patterns").alias("patterns"), "category", "risk", joined("expected_sections").alias("expected_sections"))


@query("udx_1_vendors_with_custom_rules")
def _(spark, sf_dir):
    found = V.classify(inputs(spark, sf_dir).requests, V.vendor_rules(spark, custom_rules(spark, sf_dir)))
    return found.select("host", "path", "vendor.vendor", "vendor.category")


@query("url_10_tracker_requests")
def _(spark, sf_dir):
    requests = inputs(spark, sf_dir).requests
    return requests.filter(U.is_tracker(F.col("host"), F.col("path"))).select("request_id", "tab_id", "host")


@query("url_11_tracking_cookies")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).changes.select("change_id", "name", U.tracking_cookie(F.col("name")).alias("tracking"))


@query("url_12_policy_domains")
def _(spark, sf_dir):
    return policy_facts(spark, sf_dir).select("doc_id", F.explode("policy_domains").alias("domain"))


def policy_facts(spark, sf_dir):
    from clausetrail.operators.sections import policy_facts as facts

    return facts(inputs(spark, sf_dir).view("fx_policies").select("doc_id", "body"))


@query("url_13_named_vendors")
def _(spark, sf_dir):
    return policy_facts(spark, sf_dir).select("doc_id", F.explode("named_vendors").alias("vendor"))


@query("url_14_host_disclosure")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).hosts.select("tab_id", "host", "disclosed")


@query("url_15_canonical_policy_urls")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).view("fx_fetches").select("fetch_id", U.canonical_policy_url(F.col("url")).alias("url_key"))


@query("url_16_origin_exclusion")
def _(spark, sf_dir):
    x = inputs(spark, sf_dir)
    page = x.sites.select("tab_id", F.concat(F.lit("https://"), "page_host").alias("origin"))
    # The most shown origin of each language is left out, as a user would list it.
    shown = page.join(x.sites.select("tab_id", "language"), "tab_id").groupBy("language", "origin").agg(F.count("*").alias("n"))
    listed = shown.groupBy("language").agg(F.max_by("origin", F.struct("n", "origin")).alias("origin")).filter(F.col("language").isin("ko", "fr-FR", "en-GB"))
    excluded = RQ.clean_origins(listed.select("origin"))
    events = x.requests.select("request_id", "tab_id").join(page, "tab_id")
    return RQ.exclude_origins(events, excluded).select("request_id", "tab_id", "origin")


@query("url_17_document_fingerprints")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).view("fx_requests").select("request_id", U.fingerprint(F.col("url")).alias("fingerprint"))


@query("url_18_host_countries")
def _(spark, sf_dir):
    hosts = inputs(spark, sf_dir).view("fx_requests").select("host").distinct()
    return hosts.select("host", F.coalesce(U.country_of(F.col("host")), F.lit("")).alias("country"))


@query("net_1_unique_hosts")
def _(spark, sf_dir):
    first = inputs(spark, sf_dir).requests.groupBy("tab_id", "host").agg(F.min(F.struct("ts", "request_id")).alias("f"))
    return first.select("tab_id", "host", "f.request_id")


@query("net_2_third_party_hosts")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).network.select("tab_id", joined("third_party_hosts").alias("hosts"))


@query("net_3_preferred_vendor_requests")
def _(spark, sf_dir):
    hosts = inputs(spark, sf_dir).hosts.filter("third_party")
    return hosts.select("tab_id", "host", F.col("preferred_first.request_id").alias("request_id"), "vendor")


@query("net_4_vendor_summary")
def _(spark, sf_dir):
    rows = N.vendor_summary(inputs(spark, sf_dir).hosts)
    return rows.select("tab_id", "host", "vendor", "category", "risk", joined("missing").alias("missing"))


@query("net_5_sensitive_request_fields")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).query_keys.select("tab_id", "category", joined("keys").alias("keys"))


def _finding(key: str, part: str, id: str) -> None:
    @query(key)
    def _(spark, sf_dir):
        rows = getattr(inputs(spark, sf_dir), part).select("tab_id", F.explode("findings").alias("f"))
        return rows.filter(F.col("f.id") == id).select("tab_id", F.col("f.severity").alias("severity"), joined("f.detail").alias("detail"))


_finding("net_6_undisclosed_third_parties", "network", "undisclosed_third_parties")
_finding("net_7_vendor_policy_section_gap", "network", "vendor_policy_section_gap")
_finding("net_8_tracker_without_disclosure", "network", "tracker_without_disclosure")
_finding("net_9_sensitive_fields_without_category", "network", "sensitive_fields_without_category")
_finding("net_10_third_party_post", "network", "third_party_post")
_finding("net_11_insecure_http", "network", "insecure_http")


@query("net_12_network_result")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).network.select(
        "tab_id",
        "request_count",
        F.size("third_party_hosts").alias("third_party_hosts"),
        F.size("tracker_hosts").alias("tracker_hosts"),
        F.size("vendor_summary").alias("vendors"),
        F.size("sensitive_fields").alias("sensitive_fields"),
        FN.id_severities(F.col("findings")).alias("findings"),
    )


@query("frm_1_field_categories")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).fields.select("field_id", F.coalesce("category", F.lit("")).alias("category"))


@query("frm_2_form_categories")
def _(spark, sf_dir):
    rows = inputs(spark, sf_dir).forms.select("tab_id", F.inline("categories"))
    return rows.select("tab_id", "category", F.col("n").alias("fields"), "required", joined("names").alias("names"))


_finding("frm_2_form_fields_without_policy_category", "forms", "form_fields_without_policy_category")
_finding("frm_3_many_required_sensitive_fields", "forms", "many_required_sensitive_fields")


@query("sto_1_storage_categories")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).storage_classes.select("tab_id", "category", joined("keys").alias("keys"))


_finding("sto_2_storage_without_disclosure", "storage", "storage_without_disclosure")
_finding("sto_3_tracking_cookie_without_disclosure", "storage", "tracking_cookie_without_disclosure")
_finding("sto_4_third_party_cookie_without_disclosure", "storage", "third_party_cookie_without_disclosure")
_finding("sto_5_weak_cookie_security", "storage", "weak_cookie_security")


@query("con_3_consent_banners")
def _(spark, sf_dir):
    candidates = inputs(spark, sf_dir).view("fx_candidates")
    return candidates.filter(looks_like_banner(candidates)).select("el_id", "tab_id")


@query("str_9_cookie_identity")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).changes.select("change_id", "identity")


@query("str_10_cookie_state")
def _(spark, sf_dir):
    return inputs(spark, sf_dir).cookies.select(
        "tab_id", "identity", "name", "domain", "removed", "observed", "first_set_at", "last_set_at", "deleted_at"
    )


@query("str_11_cookie_attribution")
def _(spark, sf_dir):
    """Every change with every tab it surely belongs to."""
    x = inputs(spark, sf_dir)
    return K.with_tabs(x.attributed, x.site_tabs)


@query("str_11_site_tabs")
def _(spark, sf_dir):
    """The tabs of every site that has deletes, apart from the deletes themselves."""
    return inputs(spark, sf_dir).site_tabs
