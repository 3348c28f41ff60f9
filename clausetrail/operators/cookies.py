"""Cookie changes: identity, batches, current state and which tab they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausetrail import rules as R
from clausetrail.functions import urls as U
from clausetrail.functions.patterns import let
from clausetrail.session import slots


def bare_domain(domain: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^\.", "")


def partition_origin(site: Column) -> Column:
    return F.coalesce(let(U.parts(site), lambda p: F.when(p.isNotNull(), U.origin(p))), F.lit(""))


def with_identity(changes: DataFrame) -> DataFrame:
    """Masks the name and adds ``identity``: the same cookie of the same partition, told apart without its raw name."""
    step = changes.withColumn("raw_name", F.col("name")).withColumn("name", U.masked_name(F.col("name")))
    step = step.withColumn("partition", partition_origin(F.col("partition_site")))
    kept = F.when(F.col("name") == F.col("raw_name"), F.col("name")).otherwise(F.sha2("raw_name", 256))
    optional = {c: F.col(c) if c in changes.columns else F.lit(d) for c, d in (("store_id", ""), ("cookie_path", "/"))}
    key = F.concat_ws(
        "\u0000", optional["store_id"], F.col("partition"), bare_domain(F.col("domain")), F.sha2(optional["cookie_path"], 256), kept
    )
    return step.withColumn("identity", F.sha2(key, 256)).drop("raw_name")


def _at(flag: Column) -> Column:
    return F.when(flag, F.struct("ts", "change_id"))


def coalesce_changes(changes: DataFrame, width: str = f"{R.COOKIE_BATCH_MS} milliseconds") -> DataFrame:
    """One row per identity and time batch: the latest change with earliest set, latest set and latest delete."""
    batch = changes.groupBy("tab_id", "identity", F.window("ts", width).alias("batch"))
    out = batch.agg(
        F.count("*").alias("changes"),
        F.max_by(F.struct("name", "domain", "secure", "same_site", "removed"), F.struct("ts", "change_id")).alias("latest"),
        F.min(F.when(~F.col("removed"), F.col("ts"))).alias("first_set_at"),
        F.max(F.when(~F.col("removed"), F.col("ts"))).alias("last_set_at"),
        F.max(F.when(F.col("removed"), F.col("ts"))).alias("deleted_at"),
    )
    return out.select(
        "tab_id", "identity", F.col("batch.start").alias("batch_start"), "changes", "latest.*", "first_set_at", "last_set_at", "deleted_at"
    )


def newest_of_domain(changes: DataFrame, per_domain: int, batch: str) -> DataFrame:
    """The newest ``per_domain`` changes of every batch and ``queue_domain``, with their ``turn`` from 1."""
    newest = Window.partitionBy(batch, "queue_domain").orderBy(F.desc("ts"), F.desc("change_id"))
    return changes.withColumn("turn", F.row_number().over(newest)).filter(F.col("turn") <= per_domain)


def fair_queue(changes: DataFrame, per_domain: int = R.QUEUE_PER_DOMAIN, total: int = R.QUEUE_TOTAL, batch: str = "batch_start") -> DataFrame:
    """Bounded share of each batch: the newest of every domain, then domains in turn until the batch is full."""
    turns = Window.partitionBy(batch).orderBy("turn", F.desc("ts"), F.desc("change_id"))
    shared = newest_of_domain(changes.withColumn("queue_domain", bare_domain(F.col("domain"))), per_domain, batch)
    return shared.withColumn("place", F.row_number().over(turns)).filter(F.col("place") <= total).drop("queue_domain")


def fold_changes(changes: DataFrame) -> DataFrame:
    """One row per tab and cookie: its last change, first and last set, last delete.

    The fold over changes is order-free once written as smallest and largest (time, id), so it aggregates before
    the shuffle, and states of parts of the changes merge.
    """
    return changes.groupBy("tab_id", "identity").agg(
        F.max(F.struct("ts", "change_id")).alias("last_change"),
        F.max_by(
            F.struct("name", "domain", "secure", "same_site", "removed", "partition", "change_id"), F.struct("ts", "change_id")
        ).alias("last"),
        F.min(_at(~F.col("removed"))).alias("first_set"),
        F.max(_at(~F.col("removed"))).alias("last_set"),
        F.max(_at(F.col("removed"))).alias("last_delete"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """States of the same cookie, folded from parts of its changes, as one."""
    return states.groupBy("tab_id", "identity").agg(
        F.max("last_change").alias("last_change"),
        F.max_by("last", "last_change").alias("last"),
        F.min("first_set").alias("first_set"),
        F.max("last_set").alias("last_set"),
        F.max("last_delete").alias("last_delete"),
    )


def current_cookies(state: DataFrame, cap: int | None = None) -> DataFrame:
    """Current cookies and safe tombstones of folded changes; the first ``cap`` of a tab where one is given.

    Set times count as evidence only for partitioned cookies.  A delete without earlier set evidence
    removes the cookie; with evidence it leaves a tombstone.
    """
    observed = (F.col("last.partition") != "") & F.col("first_set").isNotNull()
    live = ~F.col("last.removed")
    current = state.filter(live | observed).select(
        "tab_id",
        "identity",
        "last.*",
        observed.alias("observed"),
        F.when(observed, F.col("first_set.ts")).alias("first_set_at"),
        F.when(observed, F.col("last_set.ts")).alias("last_set_at"),
        F.when(observed & (F.col("last_delete") > F.col("first_set")), F.col("last_delete.ts")).alias("deleted_at"),
    )
    if cap is None:
        return current
    # Live cookies come before tombstones, later evidence before earlier.
    rank = Window.partitionBy("tab_id").orderBy("removed", F.desc_nulls_last("last_set_at"), F.desc("change_id"))
    return current.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= cap).drop("place")


def reconcile(changes: DataFrame, cap: int | None = None) -> DataFrame:
    """Current cookies and safe tombstones per tab (``fold_changes``, then ``current_cookies``)."""
    return current_cookies(fold_changes(changes), cap)


def _alone(tabs: DataFrame, *key: str) -> DataFrame:
    """Tabs per key and, where it is one, that tab."""
    return tabs.groupBy(*key).agg(F.count("*").alias("n"), F.min("tab_id").alias("tab_id"))


def _open_tabs(tabs: DataFrame) -> DataFrame:
    """tab_id, scheme and host of every tab whose address has a host."""
    own = tabs.select("tab_id", let(U.parts(F.col("url")), lambda p: F.struct(p["scheme"].alias("scheme"), p["host"].alias("host"))).alias("p"))
    return own.select("tab_id", "p.scheme", "p.host").filter(F.col("host") != "")


def _below(own: DataFrame) -> DataFrame:
    """Tabs by each parent of their host, with their scheme and with none."""
    parents = own.select("tab_id", "scheme", F.explode(U.host_suffixes(F.col("host"))).alias("place"))
    return parents.unionByName(parents.withColumn("scheme", F.lit("")))


def _above(keys: DataFrame) -> DataFrame:
    """Partition sites with each host above them."""
    suffixes = U.host_suffixes(F.col("place"))
    return keys.filter("scheme <> ''").withColumn("host", F.explode(F.slice(suffixes, 2, F.size(suffixes))))


def site_key(scheme: Column, place: Column) -> Column:
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), place)).otherwise(place)


def _given(changes: DataFrame) -> DataFrame:
    """change_id, removed, and the partition and domain that tell which tabs a change fits."""
    told = [F.coalesce(c, F.lit("")).alias(c) for c in ("partition", "domain")]
    return changes.select("change_id", "removed", *told)


def _places(given: DataFrame) -> DataFrame:
    """Distinct partitions and domains, with the scheme (if partitioned) and host that they stand for."""
    partitioned = F.col("partition") != ""

    def place(site: Column) -> Column:
        scheme = F.when(partitioned, site["scheme"]).otherwise("")
        host = F.when(partitioned, site["host"]).otherwise(bare_domain(F.col("domain")))
        return F.struct(scheme.alias("scheme"), host.alias("place"))

    told = given.select("partition", "domain").distinct()
    return told.withColumn("at", let(U.parts(F.col("partition")), place)).select("partition", "domain", "at.scheme", "at.place")


def attribute(changes: DataFrame, tabs: DataFrame) -> DataFrame:
    """(change_id, tab_id, site): one row for every change that surely belongs to some tab.

    A partitioned cookie belongs to tabs of its partition site, others to tabs whose host the cookie
    domain covers.  A set that fits several tabs is ambiguous and dropped; one that fits a single tab is given that
    tab.  A delete may go to all tabs of its site, so it is given the site, and ``site_tabs`` lists the tabs of
    each site apart: no row per delete and tab.  Matching is by equality on host parents.  ``tabs``: (tab_id, url), one
    row per tab.

    Tabs are counted per distinct site; a change meets one count.  Addresses are taken apart once per distinct partition.
    """
    own, given = _open_tabs(tabs), _given(changes)
    places = _places(given)
    keys = places.select("scheme", "place").distinct()
    below = keys.join(_alone(_below(own), "scheme", "place"), ["scheme", "place"])
    above = _above(keys).join(_alone(own, "scheme", "host"), ["scheme", "host"]).select("scheme", "place", "n", "tab_id")
    fits = below.unionByName(above).groupBy("scheme", "place").agg(F.sum("n").alias("n"), F.min("tab_id").alias("tab_id"))
    met = given.join(places.join(fits, ["scheme", "place"]), ["partition", "domain"]).filter(F.col("removed") | (F.col("n") == 1))
    return met.select(
        "change_id",
        F.when(~F.col("removed"), F.col("tab_id")).alias("tab_id"),
        F.when(F.col("removed"), site_key(F.col("scheme"), F.col("place"))).alias("site"),
    )


def site_tabs(changes: DataFrame, tabs: DataFrame) -> DataFrame:
    """(site, tab_id): the tabs of every site that has deletes."""
    own = _open_tabs(tabs)
    keys = _places(_given(changes).filter("removed")).select("scheme", "place").distinct()
    below = keys.join(_below(own), ["scheme", "place"]).select("scheme", "place", "tab_id")
    above = _above(keys).join(own, ["scheme", "host"]).select("scheme", "place", "tab_id")
    return below.unionByName(above).select(site_key(F.col("scheme"), F.col("place")).alias("site"), "tab_id")


# Tabs of a site that meet a delete as one array, and deletes of a site that meet the same array.
TABS_PER_BLOCK = 2_048
DELETES_PER_SLICE = 2_048


def with_tabs(attributed: DataFrame, members: DataFrame) -> DataFrame:
    """(change_id, tab_id): a row for every tab a change of ``attribute`` belongs to; ``members`` is ``site_tabs``.

    The pairs of a delete and the tabs of its site are the result and as many as they are.  The tabs of a site are cut
    into blocks and its deletes into slices; each block meets each slice in a place of its own.  These are dealt over all
    tasks by number: few bytes go in where many rows come out, so tasks must not be merged by the size of what they read.
    """
    deletes = attributed.filter("site IS NOT NULL")
    sizes = members.groupBy("site").agg(F.ceil(F.count("*") / TABS_PER_BLOCK).alias("blocks"))
    sizes = sizes.join(deletes.groupBy("site").agg(F.ceil(F.count("*") / DELETES_PER_SLICE).alias("slices")), "site")

    def dealt(rows: DataFrame, key: str, own: str, part: str) -> DataFrame:
        """Rows of a site with their share of it."""
        return rows.join(sizes, "site").withColumn(part, F.pmod(F.xxhash64(key), F.col(own)))

    def each(count: str, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1)).alias(name)

    place = ["site", "block", "slice"]
    lists = dealt(members, "tab_id", "blocks", "block").groupBy("site", "block", "slices").agg(F.collect_list(F.struct("tab_id")).alias("tabs"))
    # Plain numbers are read faster than rows, and a list of rows keeps a tab without an id.
    lists = lists.select("site", "block", F.transform("tabs", lambda t: t["tab_id"]).alias("tabs"), each("slices", "slice"))
    deletes = dealt(deletes, "change_id", "slices", "slice").select("change_id", "site", "slice", each("blocks", "block"))
    tasks = slots(attributed.sparkSession)
    met = deletes.repartition(tasks, *place).join(lists.repartition(tasks, *place).hint("merge"), place)
    pairs = met.select("change_id", F.explode("tabs").alias("tab_id"))
    return attributed.filter("site IS NULL").select("change_id", "tab_id").unionByName(pairs)
