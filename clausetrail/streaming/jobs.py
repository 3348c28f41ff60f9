"""Structured Streaming jobs over captured events.

State and progress live in the checkpoint folder, so a job continues after lost executors or a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from clausetrail.operators import cookies as K
from clausetrail.operators import requests as RQ
from clausetrail.operators import versions as V
from clausetrail.streaming import sessions as SE
from clausetrail.streaming.bucket_store import BucketStore

LATENESS = "1 hour"


def requests_in(raw: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Raw request events as minimised ones; a watermark needs zoned times."""
    return RQ.minimise(raw.withColumn("ts", F.col("ts").cast("timestamp"))).withWatermark("ts", lateness)


def visits(raw: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Visits per tab, closed by an hour without events.  Emits in append or complete mode."""
    return SE.visits(requests_in(raw, lateness))


def cookie_batches(raw: DataFrame, width: str, lateness: str = LATENESS) -> DataFrame:
    """Cookie changes merged per identity and time batch."""
    changes = raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return K.coalesce_changes(K.with_identity(changes), width)


def cookie_state(raw: DataFrame) -> DataFrame:
    """Running cookie state per tab for update or complete mode; the per-tab cap is applied by readers."""
    changes = K.with_identity(raw.withColumn("ts", F.col("ts").cast("timestamp")))
    return K.reconcile(changes, cap=None)


def once_per_key(changes: DataFrame, sent: DataFrame | None = None, event_time: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Change notices with each dedupe key at most once.

    With ``event_time`` the state holds only keys within ``lateness``; keys sent before are left out by an
    anti join with ``sent``, a table of the keys already delivered.  Without it every key is remembered.
    """
    keyed = V.with_dedupe_key(changes)
    if sent is not None:
        keyed = keyed.join(sent.select("dedupe_key").distinct(), "dedupe_key", "left_anti")
    if event_time is None:
        return keyed.dropDuplicates(["dedupe_key"])
    return keyed.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["dedupe_key"])


def to_files(stream: DataFrame, path: str, checkpoint: str, trigger_seconds: int | None = None) -> StreamingQuery:
    """Appends to a parquet folder; without an interval everything available is processed and the job ends."""
    writer: DataStreamWriter = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    timed = writer.trigger(processingTime=f"{trigger_seconds} seconds") if trigger_seconds else writer.trigger(availableNow=True)
    return timed.start(path)


def upsert_versions(stream: DataFrame, table_path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the newest version per URL in a bucketed table; a batch rewrites only the buckets its URLs are in.

    Read it with ``saved_versions``.  A replayed batch gives the same table.
    """
    store = version_store(stream, table_path, buckets)

    def merge(batch: DataFrame, epoch: int) -> None:
        store.update(batch, epoch, V.upsert)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version_store(versions: DataFrame, table_path: str, buckets: int = 64) -> BucketStore:
    return BucketStore(versions.sparkSession, table_path, versions.schema, ["url_key"], buckets)


def saved_versions(versions: DataFrame, table_path: str) -> DataFrame:
    """The table that ``upsert_versions`` keeps; ``versions`` gives the columns."""
    return version_store(versions, table_path).read()
