"""Consent banners, the choice made, and tracking before and after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions import findings as FN
from clausetrail.functions import urls as U
from clausetrail.functions.patterns import first_match, let, matches, matches_any
from clausetrail.operators.cookies import reconcile
from clausetrail.operators.sequences import running_count, scanned
from clausetrail.sources.schemas import CONSENT_PAYLOAD, TOGGLE

TOGGLES = f"array<{TOGGLE.lower()}>"
CATEGORY = "array<struct<rank:int,pos:int,rule:int,id:string,risk:string,enabled:boolean>>"
BUCKETS = ("before", "after", "unknown", "outside")


# -- the banner -------------------------------------------------------------------------


def from_columns(rows: DataFrame) -> DataFrame:
    """Nested consent records from flat columns (lists are '|'-separated text)."""
    buttons = F.filter(F.split("buttons", r"\|"), lambda b: b != "")
    toggle = F.struct(
        F.col("toggle_label").alias("label"), F.col("toggle_checked").alias("checked"), F.lit("").alias("name"), F.lit("").alias("id")
    )
    toggles = F.when(F.col("toggle_label") != "", F.array(toggle)).otherwise(F.array().cast(TOGGLES))
    container = F.struct(F.col("banner_text").alias("text"), buttons.alias("buttons"), toggles.alias("toggles"))
    shown = (F.col("banner_text") != "") | (F.col("buttons") != "") | (F.col("toggle_label") != "")
    containers = F.filter(F.array(container), lambda c: shown)
    kept = [c for c in rows.columns if c not in ("banner_text", "buttons", "toggle_label", "toggle_checked")]
    return rows.select(*kept, containers.alias("containers")).withColumn("detected", F.size("containers") > 0)


def parse_payloads(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Consent records captured as JSON, read with a fixed schema."""
    parsed = F.from_json(payload, CONSENT_PAYLOAD.replace("STRUCT", "struct"))
    rows = raw.withColumn("_p", parsed)
    return rows.select(
        *[c for c in raw.columns if c != payload],
        first_instant(F.col("_p.observed_from")).alias("observed_from"),
        first_instant(F.col("_p.choice_at")).alias("choice_at"),
        choice_kind(F.col("_p.choice_kind")).alias("choice_kind"),
        F.coalesce("_p.containers", F.array()).alias("containers"),
        F.coalesce("_p.detected", F.lit(False)).alias("detected"),
    )


def first_instant(*values: Column) -> Column:
    """First usable time among aliases: a positive number of milliseconds or a readable date text."""

    def instant(value: Column) -> Column:
        text = F.trim(value.cast("string"))
        number = text.try_cast("double")
        return F.when(number > 0, F.timestamp_millis(number.cast("bigint"))).when(number.isNull(), F.try_to_timestamp(text))

    return F.coalesce(*[instant(v) for v in values])


def choice_kind(value: Column) -> Column:
    kind = F.lower(F.trim(value))
    return F.when(kind.isin("reject_all", "necessary_only", "accept_all"), kind).when(
        kind.isin("save_preferences", "save_choices"), "save_preferences"
    )


def button_type(label: Column) -> Column:
    return first_match(F.lower(F.coalesce(label, F.lit(""))), R.CHOICE_BUTTONS, "unknown")


def recorded_choice(control: Column) -> Column:
    """Kind of a clicked control from its text and attributes, NULL when it is no choice."""
    return first_match(F.lower(control), R.RECORDED_CHOICES)


def looks_like_banner(candidates: DataFrame) -> Column:
    """Consent language or a manager's mark, with a choice, a dialog or that mark; not a long text."""
    attrs, text = F.lower("attrs"), F.lower("text")
    hay = F.concat(attrs, F.lit(" "), text)
    language = F.lit(False)
    for hint in R.CONSENT_HINTS:
        language = language | F.contains(hay, F.lit(hint))
    manager = matches(attrs, R.CONSENT_MANAGER)
    control = recorded_choice(F.col("text")).isNotNull()
    return (F.length("text") < R.CONSENT_TEXT_CHARS) & (language | manager) & (control | (F.col("role") == "dialog") | manager)


def toggle_text(toggle: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws(" ", *[F.coalesce(toggle[f], blank) for f in ("label", "name", "id")])


def categories(containers: Column) -> Column:
    """Consent categories a banner names, riskiest first, with whether any is switched on."""

    def texts(c: Column) -> Column:
        def item(text: Column, enabled: Column) -> Column:
            return F.struct(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(enabled, F.lit(False)).alias("enabled"))

        off = F.lit(False)
        return F.concat(
            F.array(item(c["text"], off)),
            F.transform(c["buttons"], lambda b: item(b, off)),
            F.transform(c["toggles"], lambda t: item(toggle_text(t), t["checked"])),
        )

    def category(all_texts: Column, rule: int, name: str, risk: str, patterns: list[str]) -> Column:
        def hit(text: Column, pos: Column) -> Column:
            return F.when(matches_any(text["text"], patterns), F.struct(pos.alias("pos"), text["enabled"].alias("enabled")))

        def row(hits: Column) -> Column:
            found = F.struct(
                F.lit(-R.SEVERITY_RANK[risk]).alias("rank"),
                hits[0]["pos"].alias("pos"),
                F.lit(rule).alias("rule"),
                F.lit(name).alias("id"),
                F.lit(risk).alias("risk"),
                F.exists(hits, lambda x: x["enabled"]).alias("enabled"),
            )
            return F.when(F.size(hits) > 0, found)

        return let(F.array_compact(F.transform(all_texts, hit)), row)

    def present(all_texts: Column) -> Column:
        rows = [category(all_texts, i, *rule) for i, rule in enumerate(R.CONSENT_CATEGORIES)]
        return F.array_sort(F.array_compact(F.array(*rows))).cast(CATEGORY)

    return let(F.flatten(F.transform(containers, texts)), present)


def _fallback(names: list[str]) -> Column:
    risk = {name: r for name, r, _ in R.CONSENT_CATEGORIES}
    return F.array(
        *[
            F.struct(F.lit(0), F.lit(i), F.lit(0), F.lit(n), F.lit(risk[n]), F.lit(False))
            for i, n in enumerate(names)
        ]
    ).cast(CATEGORY)


def allowed_categories(kind: Column, cats: Column) -> Column:
    """What a choice lets through."""

    def or_else(some: Column, names: list[str]) -> Column:
        return let(some, lambda s: F.when(F.size(s) > 0, s).otherwise(_fallback(names)))

    necessary = F.filter(cats, lambda c: c["id"] == "necessary")
    enabled = F.filter(cats, lambda c: c["enabled"] | (c["id"] == "necessary"))
    return (
        F.when(kind == "necessary_only", or_else(necessary, ["necessary"]))
        .when(kind == "accept_all", or_else(cats, R.ACCEPT_FALLBACK))
        .when(kind == "save_choices", or_else(enabled, ["necessary"]))
        .when(kind == "preferences", or_else(cats, ["necessary"]))
        .otherwise(F.array().cast(CATEGORY))
    )


def choices(consents: DataFrame) -> DataFrame:
    """One row per distinct choice of a page: (tab_id, pos, type, label, synthetic, categories, allowed).

    A banner is small and capped at eight containers, so this stays on its row.
    """
    buttons = F.flatten(F.transform("containers", lambda c: c["buttons"]))
    typed = F.transform(
        buttons, lambda b, i: F.struct(i.alias("pos"), button_type(b).alias("type"), b.alias("label"), F.concat_ws(":", button_type(b), F.lower(b)).alias("key"))
    )
    step = consents.withColumn("_typed", typed).withColumn("categories", categories(F.col("containers")))
    first = F.filter(
        "_typed", lambda t, i: (t["type"] != "unknown") & ~F.exists(F.slice("_typed", F.lit(1), i), lambda o: o["key"] == t["key"])
    )
    step = step.withColumn("_first", first)
    toggled = F.exists("containers", lambda c: F.size(c["toggles"]) > 0)
    extra = F.struct(F.lit(1_000).alias("pos"), F.lit("preferences").alias("type"), F.lit("").alias("label"), F.lit("").alias("key"))
    missing = toggled & ~F.exists("_first", lambda t: t["type"] == "preferences")
    every = F.when(missing, F.concat("_first", F.array(extra))).otherwise(F.col("_first"))
    rows = step.select("tab_id", "categories", F.inline_outer(every)).filter(F.col("pos").isNotNull())
    return rows.select(
        "tab_id",
        "pos",
        "type",
        "label",
        (F.col("key") == "").alias("synthetic"),
        "categories",
        allowed_categories(F.col("type"), F.col("categories")).alias("allowed"),
    )


def choice_risk(kind: Column, allowed: Column, inferred: Column, pre_tracking: Column) -> Column:
    def top(cats: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(cats, lambda c: FN.severity_rank(c["risk"]))), F.lit(0))

    enabled, every = top(F.filter(allowed, lambda c: c["enabled"])), top(allowed)
    adjustable = kind.isin("preferences", "save_choices")
    return (
        F.when(pre_tracking & (kind == "necessary_only"), "medium")
        .when(pre_tracking & (kind == "accept_all"), "high")
        .when(adjustable & (enabled >= 3), "high")
        .when(adjustable & ((enabled >= 2) | inferred), "medium")
        .when(kind == "preferences", F.when(every >= 3, "medium").otherwise("low"))
        .when(every >= 3, "high")
        .when((every >= 2) | inferred, "medium")
        .otherwise("low")
    )


def choice_concerns(kind: Column, allowed: Column, inferred: Column, pre_tracking: Column) -> Column:
    risky = F.exists(allowed, lambda c: c["risk"] == "high")
    middling = F.exists(allowed, lambda c: c["risk"] == "medium") & (kind != "accept_all")
    quiet = ~(risky | middling | pre_tracking | inferred)
    return F.array_compact(
        F.array(
            F.when(risky, F.lit("high_category")),
            F.when(middling, F.lit("medium_category")),
            F.when(pre_tracking, F.lit("tracking")),
            F.when(inferred, F.lit("inferred")),
            F.when((kind == "necessary_only") & quiet, F.lit("necessary_only_default")),
        )
    )


def judge_choices(choice_rows: DataFrame, timing: DataFrame) -> DataFrame:
    """Adds risk level and concerns; ``timing`` tells whether tracking ran before the choice."""
    joined = choice_rows.join(timing.select("tab_id", "pre_choice_tracking"), "tab_id", "left")
    pre = F.coalesce("pre_choice_tracking", F.lit(False))
    inferred = (F.col("type") == "accept_all") & (F.size("categories") == 0)
    args = (F.col("type"), F.col("allowed"), inferred, pre)
    return joined.withColumn("risk_level", choice_risk(*args)).withColumn("concerns", choice_concerns(*args))


def disabled_toggles(consents: DataFrame) -> DataFrame:
    """Distinct switched-off tracking toggles: (tab_id, toggle)."""
    toggles = F.flatten(F.transform("containers", lambda c: c["toggles"]))
    rows = consents.select("tab_id", F.inline(toggles))
    off = ~F.coalesce("checked", F.lit(False))
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("label", "name", "id")]))
    key = F.lower(F.concat_ws(":", *[F.coalesce(c, F.lit("")) for c in ("label", "name", "id")]))
    return rows.filter(off & matches(text, R.DISABLED_TOGGLE)).select("tab_id", key.alias("toggle")).distinct()


# -- timing -----------------------------------------------------------------------------


def timeline(consents: DataFrame) -> DataFrame:
    """The moment that divides tracking: a recorded choice, never a saved baseline."""
    known = F.col("choice_at").isNotNull()
    return consents.select(
        "tab_id",
        "observed_from",
        "choice_at",
        choice_kind(F.col("choice_kind")).alias("choice_kind"),
        F.col("choice_at").alias("boundary_at"),
        F.when(known, "choice").otherwise("none").alias("boundary_type"),
        F.when(known, "high").otherwise("low").alias("confidence"),
    )


def bucket(at: Column, observed_from: Column, boundary: Column, window_ms: int = R.CONSENT_AMBIGUITY_MS) -> Column:
    near = F.abs(F.unix_micros(at) - F.unix_micros(boundary)) <= window_ms * 1000
    return (
        F.when(at.isNull(), "unknown")
        .when(observed_from.isNotNull() & (at < observed_from), "outside")
        .when(boundary.isNull() | near, "unknown")
        .when(at < boundary, "before")
        .otherwise("after")
    )


def request_counts(requests: DataFrame, lines: DataFrame, times: DataFrame) -> DataFrame:
    """All counts of requests that a tab's boundary and baseline give, in one pass over the requests.

    ``lines``: the timeline; ``times``: (tab_id, created_at), one baseline per tab.  A tab may have either or both.
    """
    marks = lines.select("tab_id", "observed_from", "boundary_at", F.lit(True).alias("lined")).join(
        times.select("tab_id", "created_at"), "tab_id", "full"
    )
    tracks = U.is_tracker(F.col("host"), F.col("path"))
    writes = F.col("method").isin("POST", "PUT", "PATCH") & (F.col("host") != "")
    seen = requests.select("tab_id", "ts", writes.alias("writes"), tracks.alias("tracks")).join(marks, "tab_id")
    seen = seen.withColumn("bucket", F.when(F.col("tracks") & F.col("lined"), bucket(F.col("ts"), F.col("observed_from"), F.col("boundary_at"))))
    later = F.col("ts") > F.col("created_at")
    return seen.groupBy("tab_id").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("ts") <= F.col("created_at")).alias("requests_until"),
        F.count_if(later & F.col("tracks")).alias("tracking_requests"),
        F.count_if(later & F.col("writes")).alias("new_writes"),
        F.count("bucket").alias("tracked"),
        *[F.count_if(F.col("bucket") == b).alias(f"requests_{b}") for b in BUCKETS],
    )


def request_timing(counts: DataFrame) -> DataFrame:
    """Tracker requests of each tab counted by bucket, from ``request_counts``."""
    return counts.filter("tracked > 0").select("tab_id", *[f"requests_{b}" for b in BUCKETS])


def cookie_evidence(cookies: DataFrame) -> DataFrame:
    """Tracking cookies worth counting, with the set times that can be trusted (NULL for the others)."""
    known = F.col("observed")
    return cookies.filter(U.tracking_cookie(F.col("name")) & (~F.col("removed") | known)).select(
        "tab_id",
        "identity",
        F.when(known, F.col("first_set_at")).alias("first_at"),
        F.when(known, F.greatest("first_set_at", "last_set_at")).alias("last_at"),
    )


def cookie_timing(evidence: DataFrame, lines: DataFrame) -> DataFrame:
    """Cookies by bucket: first and last set may fall in two buckets, the cookie is one in ``cookies_observed``."""
    joined = evidence.join(lines, "tab_id")
    times = F.array_distinct(F.array("first_at", "last_at"))
    placed = F.array_distinct(F.transform(times, lambda t: bucket(t, F.col("observed_from"), F.col("boundary_at"))))
    rows = joined.select("tab_id", placed.alias("buckets"))
    # One row per cookie already, so counting rows counts cookies once per bucket.
    return rows.groupBy("tab_id").agg(
        *[F.count_if(F.array_contains("buckets", b)).alias(f"cookies_{b}") for b in BUCKETS],
        F.count_if(F.exists("buckets", lambda b: b != "outside")).alias("cookies_observed"),
    )


def tracking_timing(lines: DataFrame, requests: DataFrame, cookies: DataFrame) -> DataFrame:
    """One row per tab with all counts and whether tracking ran before the choice."""
    joined = lines.join(requests.hint("merge"), "tab_id", "left").join(cookies, "tab_id", "left")
    counts = [f"{kind}_{b}" for kind in ("requests", "cookies") for b in BUCKETS] + ["cookies_observed"]
    joined = joined.fillna(0, counts)
    observed = F.col("requests_before") + F.col("requests_after") + F.col("requests_unknown")
    joined = joined.withColumn("requests_observed", observed)
    early = F.when(
        F.col("boundary_at").isNotNull(), F.col("requests_before") + F.col("cookies_before")
    ).otherwise(F.col("requests_observed") + F.col("cookies_observed"))
    return joined.withColumn("pre_choice_tracking", early > 0)


# -- findings ---------------------------------------------------------------------------


def analyze(consents: DataFrame, timing: DataFrame, toggles: DataFrame) -> DataFrame:
    """One row per tab: availability of choices, tracking counts and findings."""
    kinds = F.transform(F.flatten(F.transform("containers", lambda c: c["buttons"])), button_type)
    banner = consents.select(
        "tab_id", "detected", F.size("containers").alias("banner_count"), kinds.alias("kinds")
    )
    off = toggles.groupBy("tab_id").agg(F.count("*").alias("disabled_toggles"))
    joined = timing.join(banner, "tab_id").join(off, "tab_id", "left").fillna(0, ["disabled_toggles"])
    joined = (
        joined.withColumn("reject_available", F.array_contains("kinds", "necessary_only"))
        .withColumn("accept_available", F.array_contains("kinds", "accept_all"))
        .withColumn("preference_available", F.array_contains("kinds", "preferences") | F.array_contains("kinds", "save_choices"))
    )
    c = F.col
    observed = (c("requests_observed") > 0) | (c("cookies_observed") > 0)
    started, bounded = c("observed_from").isNotNull(), c("boundary_at").isNotNull()
    before = c("requests_before") + c("cookies_before")
    after = c("requests_after") + c("cookies_after")
    unknown = c("requests_unknown") + c("cookies_unknown")
    rejected = F.coalesce(c("choice_kind").isin("reject_all", "necessary_only"), F.lit(False))
    accepted = F.coalesce(c("choice_kind") == "accept_all", F.lit(False))
    only_accept = c("detected") & c("accept_available") & ~c("reject_available")
    open_toggle = ~rejected & ~accepted & (c("disabled_toggles") > 0)

    def graded(id: str, sure: Column, unsure: Column, sure_confidence: str | None = None) -> Column:
        return F.coalesce(
            FN.finding(sure, id, "high", confidence=sure_confidence), FN.finding(unsure, id, "medium", confidence="low")
        )

    found = FN.findings(
        FN.finding(
            observed & ~c("detected"),
            "tracking_without_visible_consent",
            F.when(started, "high").otherwise("medium"),
            confidence=F.when(started, "medium").otherwise("low"),
        ),
        graded(
            "tracking_before_clear_choice",
            c("detected") & bounded & (before > 0),
            c("detected") & observed & (~bounded | (unknown > 0)),
        ),
        FN.finding(only_accept & ~c("preference_available"), "consent_no_reject_option", "medium"),
        FN.finding(only_accept & c("preference_available"), "reject_hidden_in_preferences", "medium"),
        graded("tracking_after_rejection", rejected & bounded & (after > 0), rejected & observed & (unknown > 0), "high"),
        graded(
            "tracking_despite_disabled_toggle",
            open_toggle & bounded & (after > 0),
            open_toggle & observed & (~bounded | (unknown > 0)),
        ),
    )
    return joined.withColumn("findings", found).drop("kinds")


def finding_rows(result: DataFrame, *ids: str) -> DataFrame:
    rows = result.select("tab_id", F.explode("findings").alias("f"))
    rows = rows.filter(F.col("f.id").isin(*ids)) if ids else rows
    return rows.select(
        "tab_id", F.col("f.id").alias("finding"), F.col("f.severity").alias("severity"), F.coalesce("f.confidence", F.lit("")).alias("confidence")
    )


# -- after a saved baseline -------------------------------------------------------------


def delta(baselines: DataFrame, counts: DataFrame, cookies: DataFrame) -> DataFrame:
    """What came after the baseline of each tab.

    ``baselines``: (tab_id, created_at, request_count, cookie_count), one per tab (``latest_baselines``); ``counts``:
    ``request_counts`` with these baselines.
    """
    cut = baselines.select("tab_id", "created_at")
    jar = cookies.select(
        "tab_id",
        F.col("removed"),
        F.when(F.col("observed"), F.col("last_set_at")).alias("ts"),
        U.tracking_cookie(F.col("name")).alias("tracks"),
    ).join(cut, "tab_id")
    later = F.col("ts") > F.col("created_at")
    by_cookies = jar.groupBy("tab_id").agg(
        F.count_if(~F.col("removed")).alias("live_cookies"), F.count_if(later & F.col("tracks")).alias("tracking_cookies")
    )
    by_requests = counts.select("tab_id", "requests", "tracking_requests", "new_writes")
    joined = baselines.join(by_requests.hint("merge"), "tab_id", "left").join(by_cookies, "tab_id", "left")
    joined = joined.fillna(0, ["requests", "tracking_requests", "new_writes", "live_cookies", "tracking_cookies"])
    found = FN.findings(
        FN.finding((F.col("tracking_requests") > 0) | (F.col("tracking_cookies") > 0), "tracking_after_snapshot", "high"),
        FN.finding(F.col("new_writes") > 0, "write_request_after_snapshot", "medium"),
    )
    return joined.select(
        "tab_id",
        F.greatest(F.lit(0), F.col("requests") - F.col("request_count")).alias("request_delta"),
        F.greatest(F.lit(0), F.col("live_cookies") - F.col("cookie_count")).alias("cookie_delta"),
        "tracking_requests",
        "tracking_cookies",
        found.alias("findings"),
    )


def latest_baselines(baselines: DataFrame) -> DataFrame:
    """The newest baseline of each tab."""
    newest = F.max_by(F.struct("created_at", "request_count", "cookie_count"), "created_at").alias("b")
    return baselines.groupBy("tab_id").agg(newest).select("tab_id", "b.*")


def baselines_at(times: DataFrame, counts: DataFrame, cookies: DataFrame) -> DataFrame:
    """Counts when a baseline was saved: requests and live cookies up to that moment.

    ``times``: (tab_id, created_at), one baseline per tab; ``counts``: ``request_counts`` with these.  Cookie changes
    before the moment are reconciled as of it.
    """
    before = F.col("ts") <= F.col("created_at")
    asked = counts.select("tab_id", F.col("requests_until").alias("request_count"))
    state = reconcile(cookies.join(times, "tab_id").filter(before).drop("created_at"), cap=None)
    live = state.filter(~F.col("removed")).groupBy("tab_id").agg(F.count("*").alias("cookie_count"))
    joined = times.join(asked.hint("merge"), "tab_id", "left").join(live, "tab_id", "left")
    return joined.fillna(0, ["request_count", "cookie_count"])


def request_counts_at(times: DataFrame, requests: DataFrame) -> DataFrame:
    """``times`` (tab_id, created_at), any number per tab, with the requests of the tab up to each.

    Moments and requests are one ordered scan, so no request meets every moment of its tab.
    """
    marks = times.select("tab_id", F.col("created_at").alias("ts"), F.lit((1 << 63) - 1).alias("request_id"), F.lit(True).alias("mark"))
    events = requests.select("tab_id", "ts", "request_id", F.lit(False).alias("mark")).unionByName(marks)
    counted = scanned(events, "tab_id", "ts", "request_id", running_count(~F.col("mark"), "request_count"))[0]
    return counted.filter("mark").select("tab_id", F.col("ts").alias("created_at"), "request_count")
