"""Shared steps of the named queries over the sample tables.

What several steps read (minimised requests, policy facts, host facts, pages, the analyses) is written
once as a stage table and shared by the queries of a session; ``forget`` starts over.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausetrail.operators import alignment as A
from clausetrail.operators import consent as C
from clausetrail.operators import cookies as K
from clausetrail.operators import forms_storage as FS
from clausetrail.operators import hosts as H
from clausetrail.operators import jurisdiction as J
from clausetrail.operators import network as N
from clausetrail.operators import policy as P
from clausetrail.operators import report as RP
from clausetrail.operators import requests as RQ
from clausetrail.operators import sections as S
from clausetrail.operators import vendors as V
from clausetrail.operators import versions as V2
from clausetrail.plans.stages import remove_stages, stage
from clausetrail.sources import documents as D
from clausetrail.sources.sample_views import load, spread


_SHARED: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """The inputs of this application and directory."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _SHARED:
        _SHARED[key] = Inputs(spark, str(sf_dir))
    return _SHARED[key]


def forget() -> None:
    """Drop every stage and its files, so the next query derives what it needs from the tables again."""
    for shared in _SHARED.values():
        remove_stages(shared.spark)
    _SHARED.clear()


class Inputs:
    """Audit inputs of one sample directory, as lazily built DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def view(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    @cached_property
    def sites(self) -> DataFrame:
        return stage(self.view("fx_sites"), "sites")

    @cached_property
    def requests(self) -> DataFrame:
        return stage(RQ.minimise(self.view("fx_requests")), "requests")

    @property
    def shown_policies(self) -> DataFrame:
        """The documents some page shows."""
        shown = self.sites.select("doc_id").distinct()
        policies = self.view("fx_policies").select("doc_id", "body").join(shown, "doc_id", "left_semi")
        # Costly per row, small per row: keep the rows apart where merging by size would put them together.  Dealing them by
        # their id again would be no deal of its own, and the join before it is merged by size.
        return spread(policies)

    @cached_property
    def facts(self) -> DataFrame:
        """Policy facts of the documents some page shows."""
        return stage(S.policy_facts(self.shown_policies), "policy_facts")

    @cached_property
    def changes(self) -> DataFrame:
        # Costly per row, small per row; the join before it leaves few, large parts.
        return stage(K.with_identity(spread(self.view("fx_cookie_changes"))), "changes")

    @cached_property
    def tab_urls(self) -> DataFrame:
        return self.sites.select("tab_id", F.col("page_url").alias("url"))

    @cached_property
    def attributed(self) -> DataFrame:
        return stage(K.attribute(self.changes, self.tab_urls), "attributed")

    @cached_property
    def site_tabs(self) -> DataFrame:
        return stage(K.site_tabs(self.changes, self.tab_urls), "site_tabs")

    @cached_property
    def cookies(self) -> DataFrame:
        return stage(K.reconcile(self.changes), "cookies")

    @cached_property
    def rules(self) -> DataFrame:
        return V.vendor_rules(self.spark)

    @cached_property
    def suffixes(self) -> DataFrame:
        return H.suffix_rules(self.spark)

    @cached_property
    def host_facts(self) -> DataFrame:
        hosts = N.all_hosts(self.requests, self.sites, self.facts, self.changes)
        return stage(H.host_dimension(hosts, self.suffixes), "host_facts")

    @cached_property
    def pages(self) -> DataFrame:
        return stage(N.pages_with_policy(self.sites, self.facts, self.host_facts), "pages")

    @cached_property
    def hosts(self) -> DataFrame:
        return stage(N.tab_hosts(self.requests, self.pages, self.host_facts, self.rules), "tab_hosts")

    @cached_property
    def query_keys(self) -> DataFrame:
        return N.classified_keys(N.key_rows(self.requests), "first")

    @cached_property
    def network(self) -> DataFrame:
        return stage(N.analyze(self.requests, self.pages, self.hosts, self.query_keys), "network")

    @cached_property
    def fields(self) -> DataFrame:
        return FS.classify_fields(FS.answer_fields(self.view("fx_form_fields")))

    @cached_property
    def forms(self) -> DataFrame:
        return stage(FS.analyze_forms(self.fields, self.pages), "forms")

    @cached_property
    def storage_keys(self) -> DataFrame:
        return FS.storage_keys(self.view("fx_storage_keys"))

    @cached_property
    def storage_classes(self) -> DataFrame:
        return N.classified_keys(self.storage_keys, "area")

    @cached_property
    def cookie_flags(self) -> DataFrame:
        return FS.cookie_flags(self.cookies, self.pages, self.host_facts)

    @cached_property
    def storage(self) -> DataFrame:
        return stage(FS.analyze_storage(self.storage_classes, self.storage_keys, self.cookie_flags, self.pages), "storage")

    @cached_property
    def consents(self) -> DataFrame:
        return C.from_columns(self.view("fx_consents"))

    # -- consent ------------------------------------------------------------------------

    @cached_property
    def timeline(self) -> DataFrame:
        return C.timeline(self.consents)

    @cached_property
    def request_timing(self) -> DataFrame:
        return C.request_timing(self.request_counts)

    @cached_property
    def cookie_timing(self) -> DataFrame:
        return C.cookie_timing(C.cookie_evidence(self.cookies), self.timeline)

    @cached_property
    def timing(self) -> DataFrame:
        return C.tracking_timing(self.timeline, self.request_timing, self.cookie_timing)

    @cached_property
    def consent(self) -> DataFrame:
        return stage(C.analyze(self.consents, self.timing, C.disabled_toggles(self.consents)), "consent")

    @cached_property
    def choices(self) -> DataFrame:
        return C.judge_choices(C.choices(self.consents), self.timing)

    @cached_property
    def baseline_times(self) -> DataFrame:
        """One baseline per tab, saved halfway between its first and last request."""
        span = self.requests.groupBy("tab_id").agg(
            F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi")
        )
        times = span.select("tab_id", F.timestamp_micros(F.expr("(lo + hi) div 2")).alias("created_at"))
        return stage(times, "baseline_times")

    @cached_property
    def request_counts(self) -> DataFrame:
        """What boundary and baseline of a tab make of its requests, counted in one pass."""
        return stage(C.request_counts(self.requests, self.timeline, self.baseline_times), "request_counts")

    @cached_property
    def baselines(self) -> DataFrame:
        return C.baselines_at(self.baseline_times, self.request_counts, self.changes)

    @cached_property
    def delta(self) -> DataFrame:
        return stage(C.delta(self.baselines, self.request_counts, self.cookies), "delta")

    # -- regimes, alignment, report -----------------------------------------------------

    @cached_property
    def overseas(self) -> DataFrame:
        return N.host_country_signals(self.network, self.sites)

    @cached_property
    def observed(self) -> DataFrame:
        signals = A.observed_signals(self.network, self.forms, self.storage, self.consent, self.overseas)
        return stage(signals, "observed")

    @cached_property
    def jurisdictions(self) -> DataFrame:
        return J.detect(self.sites)

    @cached_property
    def jurisdiction(self) -> DataFrame:
        return J.check(self.pages, self.observed, self.jurisdictions)

    @cached_property
    def checks(self) -> DataFrame:
        return A.checks(self.pages, self.observed, N.vendor_summary(self.hosts))

    @cached_property
    def alignment(self) -> DataFrame:
        return A.score(self.pages, self.checks)

    @cached_property
    def policy(self) -> DataFrame:
        """The analysis of each shown document; where nothing has asked for the facts yet, they come from the same pass."""
        both = stage(P.analyze(self.shown_policies, extend=S.with_facts, keep=S.FACTS), "policy")
        self.__dict__.setdefault("facts", both.select("doc_id", *S.FACTS))
        return both.drop(*S.FACTS)

    @cached_property
    def reports(self) -> DataFrame:
        policy = self.policy  # first, so that the facts are taken along
        return RP.site_reports(
            self.sites,
            policy,
            self.network,
            self.forms,
            self.storage,
            self.consent,
            self.delta,
            self.jurisdiction,
            self.alignment,
        )

    # -- versions -----------------------------------------------------------------------

    @cached_property
    def versions(self) -> DataFrame:
        """Version rows; the first version of a URL keeps only the sections it has, as older records did."""
        built = V2.build(self.view("fx_policy_versions"))
        kept = F.filter("sections", lambda s: s["found"] | (F.col("version") > 0))
        return stage(built.withColumn("sections", kept), "versions")

    @cached_property
    def comparisons(self) -> DataFrame:
        return stage(V2.compare(self.versions), "comparisons")

    @cached_property
    def newest_versions(self) -> DataFrame:
        return V2.upsert(self.versions.filter(F.col("version") < 2), self.versions.filter(F.col("version") == 2))

    @cached_property
    def check_results(self) -> DataFrame:
        """Checks with the baseline they were made against: the first version until 10 January, the newest since."""
        newest = self.newest_versions.select("url_key", F.col("captured_at").alias("newest_at"))
        checks = self.view("fx_checks").join(newest, "url_key")
        early = F.col("checked_at") < F.lit("2024-01-10 00:00:00").cast("timestamp")
        at = F.when(early, F.lit("2024-01-01 00:00:00").cast("timestamp")).otherwise(F.col("newest_at"))
        return checks.select("check_id", "url_key", at.alias("baseline_captured_at"), "checked_at", "ok", D.error_category(F.col("error_message")).alias("category"))

    @cached_property
    def health(self) -> DataFrame:
        return V2.health(self.check_results, self.newest_versions)
