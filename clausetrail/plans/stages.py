"""Stage tables: results several later steps read, written once to shared storage.

Cutting the lineage this way survives lost executors (the files do not live on them), keeps plans
small, and lets later scans prune columns.  The folder is the one the cluster names in
``spark.checkpoint.dir``; only where that is unset, as in tests, a local temporary one is used.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_WRITTEN: list[str] = []
_PASSING = threading.local()


def stage_root(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if spark.sparkContext.master.startswith("local"):
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="clausetrail-stages-"))
        return _LOCAL[0]
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` once and returns a reader of what was written."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _WRITTEN.append(path)
    getattr(_PASSING, "paths", []).append(path)
    reader = spark.read.schema(df.schema).parquet(path)
    reader._stage_path = path  # for discard
    return reader


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*staged: DataFrame) -> None:
    """Deletes the files of stages that nothing reads any more; each must be what ``stage`` returned."""
    for df in staged:
        if (path := getattr(df, "_stage_path", None)) in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)


def remove_stages(spark: SparkSession) -> None:
    """Deletes the files of all stages written so far; readers of them are of no use afterwards."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


@contextmanager
def passing_stages(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the stages that this thread has written inside; for work done over and over."""
    _PASSING.paths = []
    try:
        yield
    finally:
        for path in _PASSING.paths:
            if path in _WRITTEN:
                _WRITTEN.remove(path)
                _delete(spark, path)
        del _PASSING.paths
