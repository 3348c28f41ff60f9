"""A keyed table on files that a stream updates in place: fixed hash buckets and a manifest.

A row's bucket is a hash of its key.  An update reads the buckets its rows fall into, merges, and writes these
buckets anew below the epoch's folder; all others stay where they are.  A manifest per epoch names the epoch that
holds each bucket.  It is written under another name and renamed when all buckets are there, so readers see an epoch
whole or not at all.  An epoch that runs again starts from the manifest before it and gives the same table.  What the
newest two manifests don't name is deleted.

The number of buckets is set when the table is made and kept in its manifests; what goes through the driver is one
number for each bucket.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Manifest:
    epoch: int
    buckets: int
    held: dict[int, int]  # bucket to the epoch that holds it


class BucketStore:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._at = lambda name: hadoop.fs.Path(f"{path}/{name}")
        self._fs = hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = hadoop.io.IOUtils

    # -- manifests ----------------------------------------------------------------------

    def epochs(self) -> list[int]:
        """Epochs with a manifest, the newest last."""
        if not self._fs.exists(self._at("manifests")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, below: int | None = None) -> Manifest:
        """The newest manifest, or the newest before an epoch."""
        known = [e for e in self.epochs() if below is None or e < below]
        if not known:
            return Manifest(-1, self.buckets, {})
        stream = self._fs.open(self._at(f"manifests/{known[-1]}.json"))
        try:
            text = bytes(self._io.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()
        said = json.loads(text)
        return Manifest(known[-1], said["buckets"], {int(b): e for b, e in said["held"].items()})

    def _publish(self, manifest: Manifest) -> None:
        name = f"manifests/{manifest.epoch}.json"
        out = self._fs.create(self._at(f"{name}.new"), True)
        out.write(bytearray(json.dumps({"buckets": manifest.buckets, "held": manifest.held}).encode()))
        out.close()
        if self._fs.exists(self._at(name)):
            self._fs.delete(self._at(name), False)
        if not self._fs.rename(self._at(f"{name}.new"), self._at(name)):
            raise OSError(f"the manifest of epoch {manifest.epoch} of {self.path} could not be put in place")

    # -- rows ---------------------------------------------------------------------------

    def bucket_of(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _folder(self, epoch: int, bucket: int) -> str:
        return f"{self.path}/rows/epoch={epoch}/{BUCKET}={bucket}"

    def _rows(self, manifest: Manifest, only: set[int] | None = None) -> DataFrame:
        folders = [self._folder(e, b) for b, e in sorted(manifest.held.items()) if only is None or b in only]
        # A bucket whose last row has gone has no folder.
        folders = [f for f in folders if self._fs.exists(self._at(f.removeprefix(f"{self.path}/")))]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*folders)

    def read(self) -> DataFrame:
        """The table as the newest manifest has it."""
        return self._rows(self.manifest())

    def _touched(self, batch: DataFrame, base: Manifest) -> set[int]:
        return {r[0] for r in batch.select(self.bucket_of(base.buckets).alias("b")).distinct().collect()}

    def saved(self, batch: DataFrame, epoch: int) -> DataFrame:
        """The rows before an epoch of all buckets that a batch's keys are in."""
        base = self.manifest(below=epoch)
        return self._rows(base, self._touched(batch, base))

    def as_of(self, epoch: int) -> DataFrame:
        """The table after an epoch."""
        return self._rows(self.manifest(below=epoch + 1))

    def update(self, batch: DataFrame, epoch: int, merge: Merge) -> Manifest:
        """Replaces the buckets of the batch's keys by ``merge(saved rows of these buckets, batch)``."""
        base = self.manifest(below=epoch)
        of = self.bucket_of(base.buckets)
        touched = self._touched(batch, base)
        merged = merge(self._rows(base, touched), batch).select(*self.schema.names)
        placed = merged.withColumn(BUCKET, of).repartition(BUCKET)
        placed.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/rows/epoch={epoch}")
        made = Manifest(epoch, base.buckets, base.held | dict.fromkeys(touched, epoch))
        self._publish(made)
        self._clean(base, made)
        return made

    def _clean(self, base: Manifest, made: Manifest) -> None:
        named = {(e, b) for m in (base, made) for b, e in m.held.items()}
        for e in self.epochs():
            if e < base.epoch:
                self._fs.delete(self._at(f"manifests/{e}.json"), False)
        for folder in self._fs.listStatus(self._at("rows")):
            epoch = int(folder.getPath().getName().split("=")[1])
            inside = [f.getPath().getName() for f in self._fs.listStatus(folder.getPath())]
            held = [n for n in inside if n.startswith(BUCKET) and (epoch, int(n.split("=")[1])) in named]
            if not held and epoch < made.epoch:
                self._fs.delete(folder.getPath(), True)
            elif epoch < made.epoch:
                for n in inside:
                    if n.startswith(BUCKET) and n not in held:
                        self._fs.delete(self._at(f"rows/epoch={epoch}/{n}"), True)
