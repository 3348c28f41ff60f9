"""Streams whose micro-batches are worked on as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from clausetrail.plans.stages import passing_stages


def each_batch(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame, int], DataFrame | None]) -> StreamingQuery:
    """Runs ``work`` on every batch and writes its result below ``path``, one folder for each epoch."""

    def one(batch: DataFrame, epoch: int) -> None:
        with passing_stages(batch.sparkSession):
            out = work(batch, epoch)
            if out is not None:
                out.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
