"""Ordered scans: neighbours and running values in event order, for keys of any size and any burst.

A tab or URL may own a third of all events, and these may fall into one hour.  So rows are dealt into ranges
of (key, time, id), whose sizes are balanced by Spark's sampling whatever the values are.  Each range is scanned by
itself with window functions.  The last row a key has in a range is its edge; edges are few (one per key and
range), and a window over them carries the running state from range to range.  The edges are joined back to
the rows by key and range.  The ranges are written once, as a stage table, so all steps see the same ones.

A state table can stand for rows seen before: its rows are edges ahead of all ranges.  That is how the streams of
``streaming.ordered`` go on from batch to batch.

Null keys are one key; null times come first.  Ids tell rows of equal times apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from clausetrail.plans.stages import stage

RANGE = "_range"
Over = Callable[[WindowSpec], Column]


@dataclass(frozen=True)
class Scan:
    """What to compute along a key's rows.

    ``local``: columns over the rows of a key within a range; the last row's are the edge.  ``carried``: columns over
    the edges of a key.  ``state``: for each edge column that ``carried`` reads, its value for all rows so far, put in
    terms of the last edge.  ``result``: columns made of all these; others that begin with ``_`` go.
    """

    local: tuple[dict[str, Over], ...]
    carried: tuple[dict[str, Over], ...]
    state: dict[str, Column]
    result: dict[str, Column]


def arranged(df: DataFrame, key: str, ts: str, id: str, others: list[str] | None = None) -> DataFrame:
    """The rows in ranges of (key, time, id), as a stage table with the number of the range."""
    ranged = df.repartitionByRange(F.asc_nulls_first(key), F.asc_nulls_first(ts), F.asc_nulls_first(id))
    return stage(ranged.withColumn(RANGE, F.spark_partition_id()), "ordered")


def _upto(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def _earlier(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def scanned(df: DataFrame, key: str, ts: str, id: str, scan: Scan, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows with the scan's result, and the state of every key after them."""
    rows = df if RANGE in df.columns else arranged(df, key, ts, id)
    own = rows.columns
    within = Window.partitionBy(key, RANGE).orderBy(F.asc_nulls_first(ts), F.asc_nulls_first(id))
    for step in scan.local:
        rows = rows.withColumns({name: over(within) for name, over in step.items()})
    last = rows.withColumn("_last", F.lead(F.lit(1)).over(within).isNull()).filter("_last")
    edges = last.select(key, RANGE, *scan.state)
    if before is not None:
        edges = before.select(key, F.lit(-1).alias(RANGE), *scan.state).unionByName(edges)
    along = Window.partitionBy(key).orderBy(RANGE)
    for step in scan.carried:
        edges = edges.withColumns({name: over(along) for name, over in step.items()})
    names = [name for step in scan.carried for name in step]
    told = edges.select(F.col(key).alias("_key"), F.col(RANGE).alias("_at"), *names)
    met = rows.join(told, rows[key].eqNullSafe(told["_key"]) & (rows[RANGE] == told["_at"]))
    newest = edges.withColumn("_last", F.lead(F.lit(1)).over(along).isNull()).filter("_last")
    state = newest.select(key, *[value.alias(name) for name, value in scan.state.items()])
    kept = [c for c in own if c != RANGE and c not in scan.result]
    return met.select(*kept, *[value.alias(name) for name, value in scan.result.items()]), state


def running_count(flag: Column, name: str) -> Scan:
    """How many rows of the key up to and including this one have ``flag``."""
    counted = F.coalesce(flag, F.lit(False)).cast("bigint")
    whole = F.coalesce("_base", F.lit(0)) + F.col("_here")
    return Scan(
        ({"_here": lambda w: F.sum(counted).over(_upto(w))},),
        ({"_base": lambda w: F.sum("_here").over(_earlier(w))},),
        {"_here": whole},
        {name: whole},
    )


def previous(value: Column, name: str = "previous") -> Scan:
    """The ``value`` (a struct) of the row before, null for the first of a key."""
    return Scan(
        ({"_value": lambda w: value, "_before": lambda w: F.lag(value).over(w)},),
        ({"_carried": lambda w: F.lag("_value").over(w)},),
        {"_value": F.col("_value")},
        {name: F.coalesce("_before", "_carried")},
    )


def running_max_before(value: Column, name: str) -> Scan:
    """The largest ``value`` among the rows of the key before this one."""
    return Scan(
        ({"_held": lambda w: F.max(value).over(_upto(w)), "_before": lambda w: F.max(value).over(_earlier(w))},),
        ({"_carried": lambda w: F.max("_held").over(_earlier(w))},),
        {"_held": F.greatest("_carried", "_held")},
        {name: F.greatest("_carried", "_before")},
    )


def segments(ts: str, gap_micros: int, name: str, starts: Column | None = None) -> Scan:
    """Numbers from 1: a segment starts at a key's first row, at rows with ``starts`` and after a gap.

    A gap to or from a null time is unknown and starts a segment.
    """
    flagged = F.lit(False) if starts is None else F.coalesce(starts, F.lit(False))

    def apart(later: Column, earlier: Column) -> Column:
        return F.coalesce(F.unix_micros(later) - F.unix_micros(earlier) >= F.lit(gap_micros), F.lit(True))

    # The first row of a range is judged by its edges, all others where they stand.
    edge_opens = F.col("_first_starts") | F.col("_last_before").isNull() | apart(F.col("_first"), F.col("_last_before.ts"))
    here = F.coalesce("_base", F.lit(0)) + F.col("_opens") + F.col("_here")
    return Scan(
        (
            {
                "_later": lambda w: F.lag(F.lit(1)).over(w).isNotNull(),
                "_new": lambda w: flagged | apart(F.col(ts), F.lag(ts).over(w)),
                "_first": lambda w: F.first(ts).over(_upto(w)),
                "_first_starts": lambda w: F.first(flagged).over(_upto(w)),
                "_end": lambda w: F.struct(F.col(ts).alias("ts")),
            },
            {"_here": lambda w: F.sum((F.col("_later") & F.col("_new")).cast("bigint")).over(_upto(w))},
        ),
        (
            {"_last_before": lambda w: F.lag("_end").over(w)},
            {"_opens": lambda w: edge_opens.cast("bigint")},
            {"_base": lambda w: F.sum(F.col("_here") + F.col("_opens")).over(_earlier(w))},
        ),
        # As the first edge of a key opens a segment, one is left out here.
        {"_here": here - 1, "_first": F.col("_first"), "_first_starts": F.col("_first_starts"), "_end": F.col("_end")},
        {name: here},
    )


def with_previous(df: DataFrame, key: str, ts: str, id: str, value: Column, name: str = "previous") -> DataFrame:
    """Adds the ``value`` (a struct) of the event before, null for the first of a key."""
    return scanned(df, key, ts, id, previous(value, name))[0]


def with_running_count(df: DataFrame, key: str, ts: str, id: str, flag: Column, name: str) -> DataFrame:
    """Adds how many events of the key up to and including this one have ``flag``."""
    return scanned(df, key, ts, id, running_count(flag, name))[0]
