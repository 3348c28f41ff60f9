"""Rate sampling of requests: a token bucket per tab, over a table and over a stream.

Every top-level document refills its tab's bucket, and so does a pause long enough to earn a full
bucket.  Between such points the bucket depends on each earlier decision, so the events are split
there ("bursts") and only a burst runs in order.  A burst is read batch by batch, never held whole.  A gap to or from a
null time is unknown and counts as long enough; requests without a tab share one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausetrail import rules as R
from clausetrail.operators.sequences import Scan, arranged, scanned, segments
from clausetrail.plans.stages import stage
from clausetrail.session import ship_package
from clausetrail.streaming.batches import each_batch
from clausetrail.streaming.bucket_store import BucketStore


def admit(micros: np.ndarray, tokens: float, last: int | None, capacity: int, per_second: float) -> tuple[np.ndarray, float, int]:
    """Which of the ordered times are let through, with the bucket left behind."""
    allowed = np.zeros(len(micros), dtype=bool)
    for i, now in enumerate(micros.tolist()):
        if last is not None:
            tokens = min(float(capacity), tokens + max(0, now - last) * per_second / 1e6)
        last = now if last is None else max(last, now)
        if tokens >= 1:
            tokens -= 1
            allowed[i] = True
    return allowed, tokens, last if last is not None else 0


def _bursts(capacity: int, per_second: float) -> Scan:
    """``burst``: starts at a top-level document and after a pause that fills the bucket."""
    return segments("ts", int(np.ceil(capacity / per_second * 1e6)), "burst", F.col("main"))


def _requests(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", "tab_id", "ts", F.col("resource_type").eqNullSafe("main_frame").alias("main"))


KEY = ["no_tab", "tab", "burst"]
STATE = "burst bigint, tokens double, last bigint"


def _keyed(rows: DataFrame) -> DataFrame:
    """Tabs without nulls, so that they compare."""
    return rows.withColumns({"no_tab": F.col("tab_id").isNull(), "tab": F.coalesce("tab_id", F.lit(0))})


def _walked(rows: DataFrame, capacity: int, per_second: float) -> DataFrame:
    """Rows of bursts with ``tokens0`` and ``last0`` (null: a full bucket) in order: what is let through, and at some
    rows, always at a burst's last one, the bucket left behind."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, last, own = float(capacity), None, None
        for batch in batches:
            out = np.ones(len(batch), dtype=bool)
            left, seen = np.full(len(batch), np.nan), np.full(len(batch), -1, np.int64)
            # One partition holds many bursts, each in order.
            numbers = batch[KEY].to_numpy()
            edges = np.flatnonzero((numbers[1:] != numbers[:-1]).any(axis=1)) + 1
            for begin, end in pairwise([0, *edges.tolist(), len(batch)]):
                if begin == end:
                    continue
                if tuple(numbers[begin]) != own:
                    own = tuple(numbers[begin])
                    held = float(batch["tokens0"].iloc[begin])
                    tokens, last = (float(capacity), None) if np.isnan(held) else (held, int(batch["last0"].iloc[begin]))
                    last = None if last is not None and last < 0 else last
                counted = ~batch["main"].to_numpy()[begin:end]
                micros = batch["micros"].to_numpy()[begin:end][counted]
                allowed, tokens, after = admit(micros, tokens, last, capacity, per_second)
                last = after if len(micros) else last
                out[begin:end][counted] = allowed
                left[end - 1], seen[end - 1] = tokens, -1 if last is None else last
            yield batch[["request_id", *KEY, "micros"]].assign(allowed=out, tokens=left, last=seen)

    placed = rows.repartition(*KEY).sortWithinPartitions(*KEY, "micros", "request_id")
    return placed.mapInPandas(
        walk, "request_id bigint, no_tab boolean, tab bigint, burst bigint, micros bigint, allowed boolean, tokens double, last bigint"
    )


def _decided(bursts: DataFrame, capacity: int, per_second: float, saved: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(request_id, tab_id, allowed) of every row and, where there is a state to go on from, the state after them."""
    micros = F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("micros")
    ordered = stage(_keyed(bursts).select("request_id", *KEY, "main", micros), "bursts")
    tab = F.when(~F.col("no_tab"), F.col("tab")).alias("tab_id")
    joined = ordered.join(ordered.groupBy(*KEY).agg(F.count("*").alias("n")), KEY)
    # A fresh burst no longer than the bucket is let through whole and needs no walk.
    walks = F.col("n") > capacity
    if saved is None:
        joined = joined.withColumns({"tokens0": F.lit(None).cast("double"), "last0": F.lit(None).cast("bigint")})
    else:
        held = _keyed(saved).select(*KEY, F.col("tokens").alias("tokens0"), F.col("last").alias("last0"))
        newest = ordered.groupBy("no_tab", "tab").agg(F.max("burst").alias("newest"))
        joined = joined.join(held, KEY, "left").join(newest, ["no_tab", "tab"])
        # Bursts that go on, before or after this batch, are walked for the state they leave.
        walks = walks | F.col("tokens0").isNotNull() | (F.col("burst") == F.col("newest"))
    short = joined.filter(~walks).select("request_id", tab, F.lit(True).alias("allowed"))
    walked = _walked(joined.filter(walks).select("request_id", *KEY, "main", "micros", "tokens0", F.coalesce("last0", F.lit(-1)).alias("last0")), capacity, per_second)
    if saved is None:
        return short.unionByName(walked.select("request_id", tab, "allowed")), None
    walked = stage(walked, "walked")
    last = F.max_by(F.struct("burst", "tokens", "last"), F.struct("burst", "micros", "request_id")).alias("s")
    state = walked.filter(~F.isnan("tokens")).groupBy("no_tab", "tab").agg(last).select(tab, "s.*")
    return short.unionByName(walked.select("request_id", tab, "allowed")), state


def sample(requests: DataFrame, capacity: int = R.BURST_CAPACITY, per_second: float = R.REFILL_PER_SECOND) -> DataFrame:
    """(request_id, tab_id, allowed) for every request; top-level documents are always allowed."""
    ship_package(requests.sparkSession)
    bursts = scanned(_requests(requests), "tab_id", "ts", "request_id", _bursts(capacity, per_second))[0]
    return _decided(bursts, capacity, per_second)[0]


def sample_stream(
    requests: DataFrame, path: str, checkpoint: str, capacity: int = R.BURST_CAPACITY, per_second: float = R.REFILL_PER_SECOND, buckets: int = 64
) -> StreamingQuery:
    """Streaming form: (request_id, tab_id, allowed) below ``path``, the bucket of each tab kept in a bucketed table.

    Each batch is sampled as a batch table is; bursts go on from the state before it.  A late request counts as made when
    its tab was last seen, so it doesn't refill a bucket.
    """
    ship_package(requests.sparkSession)

    def work(batch: DataFrame, epoch: int) -> DataFrame | None:
        plan = _bursts(capacity, per_second)
        fresh = stage(_requests(batch), "requests")
        if fresh.isEmpty():
            return None
        empty = scanned(arranged(fresh.limit(0), "tab_id", "ts", "request_id"), "tab_id", "ts", "request_id", plan)[1]
        bucket = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in STATE.split(", "))]
        store = BucketStore(batch.sparkSession, f"{path}-state", empty.select("*", *bucket).schema, ["tab_id"], buckets)
        seen = store.saved(fresh, epoch).select(F.col("tab_id").alias("own_tab"), F.col("_end.ts").alias("last_seen"))
        timed = fresh.join(seen, fresh["tab_id"].eqNullSafe(seen["own_tab"]), "left")
        timed = timed.select("request_id", "tab_id", F.when(F.col("ts").isNotNull(), F.greatest("ts", "last_seen")).alias("ts"), "main")
        rows = arranged(timed, "tab_id", "ts", "request_id")
        made: list[DataFrame] = []

        def merge(saved: DataFrame, _: DataFrame) -> DataFrame:
            numbered, edges = scanned(rows, "tab_id", "ts", "request_id", plan, saved.select(*empty.columns))
            decided, after = _decided(numbered, capacity, per_second, saved.select("tab_id", "burst", "tokens", "last"))
            made.append(decided)
            kept = saved.select(F.col("tab_id").alias("own_tab"), "burst", "tokens", "last")
            fresh = after.withColumnRenamed("tab_id", "own_tab")
            kept = kept.join(fresh.select(F.col("own_tab").alias("new_tab")), F.col("own_tab").eqNullSafe(F.col("new_tab")), "left_anti")
            buckets_ = kept.unionByName(fresh.select(*kept.columns))
            return edges.join(buckets_, edges["tab_id"].eqNullSafe(buckets_["own_tab"]), "left").drop("own_tab")

        store.update(rows.select("tab_id"), epoch, merge)
        return made[0]

    return each_batch(requests, path, checkpoint, work)
