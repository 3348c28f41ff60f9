"""Mixing sources to target weights by fitting word budgets with a bounded knapsack.

Documents are counted by exact length in words.  A source whose budget exceeds its size takes all its
documents once for each whole pass, and the rest of the budget is fitted by choosing how many
documents of each length to take once more: the same share of every length first, then the longest
that still fit, and what is left (at most ``dp_words``, or the longest length) by a dynamic program
over attainable sums with bounded counts.  So the mix keeps the source's distribution of lengths and
its words meet the budget, mostly exactly.  Which documents of a length are taken follows from a seeded
hash of their id.

The table of lengths has one row for each (source, length).  With D lengths a source has at least
D * D / 2 words, so a source's lengths fit one task for any size of the source.  The rank of a document
among those of its length is found in two steps, by seeded ranges of about the square root of the group
and inside the one range, so one length with a third of all documents is spread over many tasks.

Defined results: a null text has size 0; a null source is a source, after all others; sources of size
0 get target 0; documents of size 0 are never taken; rows with equal ``doc_id`` are ranked one after
the other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausetrail.llm.common import prepare, stage

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def _tag(source: str = "source") -> Column:
    """The source as a name that isn't null: null is empty, others have a mark before them."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes: source and size, one row per source.  Adds target.

    Sources fill up together in proportion to their weights; one that reaches ``cap`` times its size
    stops.  With sources in order of cap / weight, the level all others reach is the first one that
    doesn't exceed the next cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", cycle.cast("double")).withColumn("limit", cap * F.col("size"))
    weighed = weighed.withColumn("full_at", F.col("limit") / F.col("weight"))
    by_limit = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    levels = (
        weighed.withColumn("full", F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (share * F.sum("size").over(whole) - F.col("full")) / F.col("open"))
    )
    reached = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(whole)["level"]
    everything = F.coalesce(reached, F.max("full_at").over(whole))
    return levels.withColumn("reached", everything).select(
        "source", "size", F.least(F.col("reached") * F.col("weight"), F.col("limit")).alias("target")
    )


def knapsack(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size to take so that the sum is the largest that doesn't exceed ``budget``.

    ``first[s]`` is the first item by which sum s was attainable; items are powers of two of each size,
    so walking back from the best sum uses each item once.
    """
    taken = [0] * len(sizes)
    if budget <= 0:
        return taken
    first = np.full(budget + 1, -1, np.int32)
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for at, (size, count) in enumerate(zip(sizes, counts)):
        left, power = min(count, budget // size), 1
        while left > 0:
            many = min(power, left)
            left -= many
            power *= 2
            weight = size * many
            new = np.flatnonzero(reach[:-weight] & ~reach[weight:]) + weight
            first[new] = len(items)
            reach[new] = True
            items.append((at, many))
        if reach[budget]:
            break
    total = int(np.flatnonzero(reach)[-1])
    while total:
        at, many = items[first[total]]
        taken[at] += many
        total -= sizes[at] * many
    return taken


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = 1 << 16) -> np.ndarray:
    """Documents to take of each length; their words come to ``budget`` or a little less."""
    total = sum(int(s) * int(c) for s, c in zip(sizes, counts))
    taken = np.zeros(len(sizes), np.int64)
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return counts.astype(np.int64)
    exact = counts * (budget / total * (1 - 1e-12))
    taken = np.minimum(np.floor(exact).astype(np.int64), counts)
    left = budget - sum(int(s) * int(t) for s, t in zip(sizes, taken))
    for at in np.argsort(-sizes, kind="stable").tolist():
        if left <= dp_words:
            break
        more = min(int(counts[at] - taken[at]), 1, left // int(sizes[at]))
        taken[at] += more
        left -= more * int(sizes[at])
    fits = np.flatnonzero((counts > taken) & (sizes <= left))
    order = fits[np.argsort(-sizes[fits], kind="stable")]
    more = knapsack(sizes[order].tolist(), (counts - taken)[order].tolist(), left)
    taken[order] += np.array(more, np.int64)
    return taken


def _fit(dp_words: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        target, total = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
        passes = int(target // total) if total else 0
        rows["passes"] = passes
        rows["more"] = 0
        worded = (rows["size"] > 0).to_numpy()
        sizes, counts = rows["size"].to_numpy(np.int64)[worded], rows["n"].to_numpy(np.int64)[worded]
        rows.loc[worded, "more"] = fit_counts(sizes, counts, round(target - passes * total), dp_words)
        return rows

    return run


def plan(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float, dp_words: int) -> DataFrame:
    """One row for each source and length: whole passes, and documents to take once more."""
    lengths = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    lengths = stage(lengths, "lengths")
    sources = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")), weights, share, cap)
    rows = lengths.select(_tag().alias("tag"), "source", "size", "n").join(
        sources.select(_tag().alias("tag"), F.col("size").cast("bigint").alias("source_size"), "target"), "tag"
    )
    return rows.groupBy("tag").applyInPandas(
        _fit(dp_words),
        "tag string, source string, size bigint, n bigint, source_size bigint, target double, passes bigint, more bigint",
    ).drop("source")


def choose(
    sized: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 11,
    dp_words: int = 1 << 16,
) -> DataFrame:
    """sized: doc_id, source and size.  Adds source_size, target and copies (0, 1 or 2)."""
    prepare(sized.sparkSession)
    budget = stage(plan(sized, weights, share, cap, dp_words), "budget")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 32)
    drawn = sized.withColumn("tag", _tag()).withColumn("draw", draw).join(budget, ["tag", "size"])
    ranges = F.ceil(F.sqrt("n"))
    drawn = drawn.withColumn("range", F.floor(F.col("draw") / F.lit(float(1 << 32)) * ranges).cast("bigint"))
    group = ["tag", "size", "range"]
    before = Window.partitionBy("tag", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = drawn.groupBy(*group).agg(F.count("*").alias("in_range")).withColumn("start", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("draw", "doc_id"))
    ranked = drawn.join(starts.drop("in_range"), group).withColumn("rank", F.col("start") + inside)
    copies = F.col("passes") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, copies).otherwise(0)
    return ranked.select("doc_id", "source", "tag", "size", "source_size", "target", copies.cast("int").alias("copies"))


def sized_documents(docs: DataFrame) -> DataFrame:
    return stage(docs.select("doc_id", "source", word_count().alias("size")), "sized")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11) -> DataFrame:
    """The mixed documents: each as often as the mix takes it, with the columns of ``docs``.

    Rows alike in id, source and size share their copies out among themselves.
    """
    chosen = choose(sized_documents(docs), weights, share, cap, seed)
    alike = ["id", "tag", "size"]
    copies = chosen.withColumnRenamed("doc_id", "id").groupBy(*alike).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    copies = copies.filter("copies > 0").withColumn("has_id", F.col("id").isNotNull()).withColumn("id", F.coalesce("id", F.lit(0)))
    rows = docs.select(
        F.struct("*").alias("doc"),
        F.col("doc_id").isNotNull().alias("has_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        _tag().alias("tag"),
        word_count().alias("size"),
    )
    met = rows.join(copies, ["has_id", *alike])
    number = F.row_number().over(Window.partitionBy("has_id", *alike).orderBy(F.xxhash64("doc")))
    own = F.floor(F.col("copies") / F.col("rows")) + F.when(number <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    return met.select("doc", own.cast("int").alias("own")).select("doc", F.explode(F.array_repeat(F.lit(1), F.col("own")))).select("doc.*")
