"""Repeated passages: content-defined chunks by a gear rolling hash, deduplicated by digest.

A cut stands where the rolling hash of the last 16 bytes meets a mask, at least ``MIN_BYTES`` after the
cut before; so cuts move with the text and an insertion changes only the chunks around it.  Chunks with
equal digests are repeats.  A digest's smallest ``doc_id`` holds the passage first; its chunks in documents with larger ids
are later copies.  Successive later copies form a passage, and passages of ``least_bytes`` or more are the result:
single chunks are short, and common phrases would be taken for copies.

Digests are counted with partial sums, never gathered.  What is gathered are the later chunks of one document.

Defined results: null and empty texts have no chunk; a null ``doc_id`` counts as the largest; rows with equal ``doc_id`` take
nothing from one another, and repeats inside a document stay; a chunk holds up to ``MAX_BYTES`` bytes, so a very long text
is many chunks; other columns, of any name, pass through ``remove_repeats`` untouched; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausetrail.llm.common import prepare, stage, text_bytes

MIN_BYTES, MAX_BYTES, MASK_BITS = 24, 256, 4
LEAST_BYTES = 160
SPAN = 512  # above the size of any chunk
LAST_ID = (1 << 63) - 1
_GEAR = np.random.default_rng(20240101).integers(0, 1 << 16, 256, dtype=np.uint16)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    raw = _GEAR[np.frombuffer(data, np.uint8)]
    rolled = np.zeros(len(raw), np.uint16)
    for k in range(min(16, len(raw))):
        rolled[k:] += raw[: len(raw) - k] << np.uint16(k)
    ends, last = [], 0
    for at in [*(np.flatnonzero(rolled >> np.uint16(16 - MASK_BITS) == 0) + 1).tolist(), len(raw)]:
        while at - last > MAX_BYTES:
            last += MAX_BYTES
            ends.append(last)
        if at - last >= MIN_BYTES or at == len(raw) and at > last:
            ends.append(at)
            last = at
    return ends


def chunk_rows(docs: DataFrame) -> DataFrame:
    """row, id, at, high and low of every chunk: its start in bytes with its size, and its digest as two numbers.

    These rows are dealt out twice, so they are narrow.
    """
    prepare(docs.sparkSession)

    @F.arrow_udf("array<struct<at:bigint,high:bigint,low:bigint>>")
    def chunks(texts: pa.Array) -> pa.Array:
        from xxhash import xxh3_128_digest

        ats, digests, sizes = [], [], [0]
        for text in texts:
            data = text.as_py()
            own = cuts(data)
            for a, b in zip([0, *own[:-1]], own):
                ats.append(a * SPAN + b - a)
                digests.append(xxh3_128_digest(data[a:b]))
            sizes.append(len(ats))
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        fields = [pa.array(ats, pa.int64()), *(pa.array(np.ascontiguousarray(halves[:, k])) for k in range(2))]
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(fields, ["at", "high", "low"]))

    found = docs.select("row", "id", chunks.asNondeterministic()(text_bytes("text")).alias("c"))
    return found.select("row", "id", F.inline("c"))


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)), "row": F.monotonically_increasing_id()})


def later_passages(numbered: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """row, start, end of every passage that documents with smaller ids hold."""
    chunks = stage(chunk_rows(numbered.select("row", "id", "text")), "chunks")
    holders = chunks.groupBy("high", "low").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    later = chunks.join(holders.select("high", "low", "first"), ["high", "low"]).filter("id > first")
    size, start = F.pmod("at", F.lit(SPAN)), F.expr(f"at div {SPAN}")
    later = later.select("row", start.alias("start"), size.alias("size"))
    # Chunks that follow one another have the same difference to the bytes of later chunks before them.
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    run = F.col("start") - F.coalesce(F.sum("size").over(before), F.lit(0))
    end = F.max(F.col("start") + F.col("size"))
    runs = later.withColumn("run", run).groupBy("row", "run").agg(F.min("start").cast("int").alias("start"), end.cast("int").alias("end"))
    return runs.filter(F.col("end") - F.col("start") >= least_bytes).select("row", "start", "end")


def _per_row(passages: DataFrame) -> DataFrame:
    return passages.groupBy(F.col("row").alias("own_row")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def repeats(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Per document: its bytes, the repeated passages that an earlier document holds, their bytes and spans."""
    numbered = stage(_numbered(docs.select("doc_id", "text")), "numbered", "zstd")
    found = _per_row(later_passages(numbered, least_bytes))
    rows = numbered.select("row", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    met = rows.join(found, rows["row"] == found["own_row"], "left")
    removable = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    named = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return met.select(
        "doc_id",
        "n_bytes",
        F.coalesce(F.size("spans"), F.lit(0)).cast("bigint").alias("n_passages"),
        F.coalesce(removable, F.lit(0)).alias("removable_bytes"),
        F.coalesce(named, F.lit("")).alias("spans"),
    )


def _without(text: Column, spans: Column) -> Column:
    """The parts of a text, as bytes, between its spans."""
    data = text.cast("binary")
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), spans)
    until = lambda i: F.coalesce(F.try_element_at(spans, i + 1)["start"], F.octet_length(text))
    kept = F.transform(edges, lambda s, i: F.substring(data, s["end"] + 1, until(i) - s["end"]))
    return F.make_valid_utf8(F.aggregate(kept, F.lit(b""), lambda a, b: F.concat(a, b)).cast("string"))


def remove_repeats(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The documents, each text without the passages that documents with smaller ids hold.

    Where a cut splits a character, its remaining bytes become replacement characters.
    """
    whole = docs.select(F.struct("*").alias("doc"), "doc_id", "text")
    numbered = stage(_numbered(whole), "numbered", "zstd")
    found = _per_row(later_passages(numbered.select("row", "id", "text"), least_bytes))
    met = numbered.join(found, numbered["row"] == found["own_row"], "left")
    text = F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(_without(F.col("doc.text"), F.col("spans")))
    return met.select(*[text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
