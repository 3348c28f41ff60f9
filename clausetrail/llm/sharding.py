"""Two-pass shuffle into shards: scatter into buckets that fit in memory, then permute each bucket.

Pass one deals every document to a bucket: the shard by a consistent hash of its id (one more shard
takes rows only into itself), the bucket inside the shard by a seeded hash of the whole row.  The
number of buckets follows from the size of a shard's texts, so a bucket has about ``bucket_bytes``
however large the table is and however many rows have one id.  Identical rows are told apart by how
many of them stood before in their partition; what is dealt is written once and read back, so that
number is fixed.  Pass two loads one bucket at a time, permutes it with a seeded Fisher-Yates shuffle
and writes it.  A bucket's rows are first put in a fixed order, so a task that runs again (a lost
executor) writes the same rows in the same order.

Defined results: a null ``doc_id`` counts as one more key; a null text has no bytes and checksum 0;
rows with equal ``doc_id`` go to one shard, as the law asks, but to any of its buckets; other columns are kept as they are,
also where their names equal those made here (they travel inside one struct); an empty table gives
an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from clausetrail.llm.common import prepare, stage, text_bytes

LAW = "key"


def shard_of(key: Column, shards: int) -> Column:
    """Shard with the highest seeded hash of the key; a further shard only takes rows into itself."""
    scores = [F.struct(F.xxhash64(F.lit(f"shard {i}"), key).alias("h"), F.lit(i).alias("i")) for i in range(shards)]
    return F.greatest(*scores)["i"] if shards > 1 else F.lit(0)


def text_size(text: str = "text") -> Column:
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("bigint")


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A permutation of 0..n-1: position i swaps with a random one of the first i + 1."""
    order = np.arange(n)
    picks = rng.integers(0, np.arange(1, n + 1)) if n else []
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


def _before():
    @F.arrow_udf("int")
    def before(hashes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """How many rows of the partition had the same hash before."""
        seen: defaultdict[int, int] = defaultdict(int)
        for batch in hashes:
            out = []
            for h in batch.to_pylist():
                out.append(seen[h])
                seen[h] += 1
            yield pa.array(out, pa.int32())

    return before.asNondeterministic()


def _permute(seed: int):
    def run(bucket: pa.Table) -> pa.Table:
        shard, part = bucket.column("shard")[0].as_py(), bucket.column("bucket")[0].as_py()
        bucket = bucket.take(pa.compute.sort_indices(bucket, [("key_hash", "ascending"), ("row_hash", "ascending")]))
        order = fisher_yates(bucket.num_rows, np.random.default_rng([seed, shard, part]))
        out = bucket.take(pa.array(order))
        slots = pa.array(np.arange(bucket.num_rows, dtype=np.int64))
        slots = pa.compute.add(slots, bucket.column("bucket_start")[0])
        return pa.table([out.column("shard"), slots, out.column("doc")], names=["shard", "slot", "doc"])

    return run


def shard_documents(docs: DataFrame, shards: int = 16, bucket_bytes: int = 8 << 20, seed: int = 7) -> DataFrame:
    """shard, slot and doc (the whole row): where each document stands after the shuffle."""
    import pyarrow.compute  # noqa: F401

    spark = docs.sparkSession
    prepare(spark)
    key = F.col("doc_id")
    shard = shard_of(key, shards).cast("int")
    # One row for each shard.
    sizes = {r["shard"]: r["n"] for r in docs.groupBy(shard.alias("shard")).agg(F.sum(text_size()).alias("n")).collect()}
    buckets = F.array(*[F.lit(max(1, -(-int(sizes.get(i) or 0) // bucket_bytes))) for i in range(shards)])
    dealt = docs.select(
        shard.alias("shard"),
        F.xxhash64(F.lit(seed), key).alias("key_hash"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_hash"),
        F.struct("*").alias("doc"),
    ).withColumn("copy", _before()("row_hash"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), "key_hash", "row_hash", "copy"), F.get(buckets, F.col("shard"))).cast("int")
    rows = stage(dealt.withColumn("bucket", bucket).select("shard", "bucket", "key_hash", "row_hash", "doc"), "dealt", "zstd")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each bucket, whatever the number of documents in it.
    starts = (
        rows.groupBy("shard", "bucket")
        .count()
        .select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("bigint").alias("bucket_start"))
    )
    placed = rows.join(starts, ["shard", "bucket"])
    doc = placed.schema["doc"].dataType.simpleString()
    return placed.groupBy("shard", "bucket").applyInArrow(_permute(seed), f"shard int, slot bigint, doc {doc}")


def write_shards(docs: DataFrame, path: str, shards: int = 16, bucket_bytes: int = 8 << 20, seed: int = 7) -> None:
    """Parquet files below ``shard=N`` folders; ``slot`` is a row's position in its shard."""
    shard_documents(docs, shards, bucket_bytes, seed).write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, documents: StructType) -> DataFrame:
    """slot, doc and shard of written shards; ``documents`` is the schema of their rows."""
    shape = StructType().add("slot", LongType()).add("doc", documents).add("shard", IntegerType())
    return spark.read.schema(shape).parquet(path)


def placements(written: DataFrame, shards: int = 16) -> DataFrame:
    """The placement of every written document with its digests."""
    data = text_bytes(F.col("doc.text"))
    return written.select(
        F.col("doc.doc_id").alias("doc_id"),
        (F.octet_length(data) + 1).cast("bigint").alias("size"),
        F.crc32(data).cast("bigint").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"),
        shard_of(F.col("doc.doc_id"), shards + 1).cast("int").alias("grown_shard"),
    )
