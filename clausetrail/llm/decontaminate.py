"""Benchmark passages in documents: a broadcast hash set of test windows, scanned and verified.

A window is ``window`` consecutive words of a benchmark item; a shorter item is one window.  Every
distinct window becomes a hash.  A task slides over the words of a whole document with the same rolling
hash, looks each position up in the sorted hashes and verifies each find word by word, so a hash
collision is no find.

The set that is sent to all tasks holds at most ``block_windows`` windows.  A larger benchmark is cut
into that many more blocks by a hash of the window; documents are scanned once per block and the
finds of a document are merged, so the result doesn't depend on the number of blocks.

Defined results: a null text or item text has no words; an item without words has no window; equal
items are each counted; a null ``item_id`` counts as an item with an empty name; rows with equal
``doc_id`` each get a result; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clausetrail.llm.common import prepare, stage, text_bytes

WINDOW = 13
# 0-9, a-z and all bytes of non-ASCII characters are word bytes; A-Z count as a-z.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)
SPANS_TYPE = "array<struct<a:int,b:int>>"
HIT_TYPE = f"struct<n_words:bigint,hits:{SPANS_TYPE},items:array<string>>"


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def _rolling(numbers: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each run of ``size`` word numbers."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(numbers) - size + 1, np.uint64)
        for i in range(size):
            out = out * _BASE + numbers[i : i + len(out)]
    return out


class WindowSet:
    """The windows of a block, by length; each with the items it occurs in."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], list[str]]]):
        self.numbers: dict[bytes, int] = {}
        for words, _ in windows:
            for word in words:
                self.numbers.setdefault(word, len(self.numbers) + 1)
        by_size: dict[int, dict[int, list]] = {}
        for words, items in windows:
            numbers = np.array([self.numbers[w] for w in words], np.uint64)
            by_size.setdefault(len(words), {}).setdefault(int(_rolling(numbers, len(words))[0]), []).append(
                (tuple(numbers.tolist()), items)
            )
        self.by_size = [(size, np.array(sorted(found), np.uint64), found) for size, found in sorted(by_size.items())]

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, spans of hit words (end exclusive, joined where they touch), items."""
        words = words_of(data)
        get = self.numbers.get
        numbers = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        known = numbers != 0
        marks, items = np.zeros(len(words) + 1, np.int64), set()
        if not known.any():
            return len(words), [], items
        unknown_before = np.concatenate(([0], np.cumsum(~known)))
        for size, hashes, found in self.by_size:
            if size > len(words):
                continue
            starts = np.flatnonzero(unknown_before[size:] == unknown_before[: len(words) - size + 1])
            if not len(starts):
                continue
            rolled = _rolling(numbers, size)[starts]
            at = np.searchsorted(hashes, rolled)
            at[at == len(hashes)] = 0
            for start in starts[hashes[at] == rolled].tolist():
                own = tuple(numbers[start : start + size].tolist())
                for window, names in found[int(_rolling(numbers[start : start + size], size)[0])]:
                    if window == own:
                        marks[start] += 1
                        marks[start + size] -= 1
                        items.update(names)
        hit = np.cumsum(marks[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        return len(words), [tuple(x) for x in edges.reshape(-1, 2).tolist()], items


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(data)
                found = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(found), pa.string()), pa.array(list(found), pa.binary())], names=["item", "window"]
                )

    return run


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """window (words joined by a space, as bytes) and item: each distinct window of each item."""
    prepare(benchmark.sparkSession)
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), text_bytes("text"))
    return named.mapInArrow(_item_windows(window), "item string, window binary").distinct()


def scanner(windows: WindowSet, spark: SparkSession):
    """Column function: bytes of a text -> n_words, spans of hit words, items."""
    held = spark.sparkContext.broadcast(windows)

    @F.arrow_udf(HIT_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        rows = [held.value.scan(x.as_py()) for x in texts]
        spans = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.StructArray.from_arrays(
            [
                pa.array([n for n, _, _ in rows], pa.int64()),
                pa.array([[{"a": a, "b": b} for a, b in hits] for _, hits, _ in rows], spans),
                pa.array([sorted(items) for _, _, items in rows], pa.list_(pa.string())),
            ],
            ["n_words", "hits", "items"],
        )

    return scan.asNondeterministic()


def window_sets(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[WindowSet]:
    """One set for each block; a block is gathered when it is asked for, so one is held at a time."""
    rows = stage(benchmark_windows(benchmark, window), "windows")
    blocks = max(1, -(-rows.count() // block_windows))
    for block in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        found: dict[bytes, list[str]] = {}
        for row in own.toLocalIterator():
            found.setdefault(bytes(row["window"]), []).append(row["item"])
        yield WindowSet([(tuple(text.split(b" ")), items) for text, items in found.items()])


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = 500_000) -> DataFrame:
    """doc (the whole row), n_words, hits and items of every document.

    With one block this is a map over documents.  With more, documents get a number, and the finds of
    all blocks (only of documents that have some) are grouped by it.
    """
    spark = docs.sparkSession
    prepare(spark)
    sets = window_sets(benchmark, window, block_windows)
    first = next(sets)
    rest = list(_later(sets, spark))
    whole = docs.select(F.struct("*").alias("doc"), text_bytes("text").alias("data"))
    if not rest:
        found = whole.select("doc", scanner(first, spark)("data").alias("f"))
        return found.select("doc", "f.n_words", "f.hits", "f.items")
    numbered = stage(whole.withColumn("row_number", F.monotonically_increasing_id()), "numbered")
    scans = [scanner(first, spark), *rest]
    sized = numbered.select("doc", "row_number", scans[0]("data").alias("f"))
    hits = [numbered.select("row_number", scan("data").alias("f")).filter("size(f.hits) > 0") for scan in scans]
    merged = (
        _union(hits)
        .groupBy("row_number")
        .agg(F.flatten(F.collect_list("f.hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("f.items"))).alias("items"))
    )
    merged = merged.select("row_number", _joined_spans("hits").alias("hits"), F.sort_array("items").alias("items"))
    return (
        sized.select("doc", "row_number", "f.n_words")
        .join(merged, "row_number", "left")
        .select(
            "doc",
            "n_words",
            F.coalesce("hits", F.array().cast(SPANS_TYPE)).alias("hits"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def _later(sets: Iterator[WindowSet], spark) -> Iterator:
    for windows in sets:
        yield scanner(windows, spark)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _joined_spans(spans: str):
    """Sorted spans joined where they overlap or touch."""
    start = F.array().cast(SPANS_TYPE)

    def add(out, span):
        last = F.element_at(out, -1)
        apart = (F.size(out) == 0) | (F.try_element_at(out, F.lit(-1))["b"] < span["a"])
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], span["b"]).alias("b"))
        return F.when(apart, F.concat(out, F.array(span))).otherwise(
            F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer))
        )

    return F.aggregate(F.sort_array(spans), start, add)


def hit_words() -> Column:
    return F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, s: n + (s["b"] - s["a"]))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words, and one, is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = find_hits(docs.select("doc_id", "text"), benchmark, window, block_windows).withColumn("n_hit", hit_words())
    return found.select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = 500_000) -> DataFrame:
    """Without the contaminated documents; columns stay."""
    found = find_hits(docs, benchmark, window, block_windows).withColumn("n_hit", hit_words())
    return found.filter(~is_contaminated(F.col("n_hit"), F.col("n_words"))).select("doc.*")


@F.arrow_udf(StringType())
def _without(texts: pa.Array, hits: pa.Array) -> pa.Array:
    out = []
    for text, spans in zip(texts.to_pylist(), hits.to_pylist()):
        if text is None or not spans:
            out.append(text)
            continue
        data = text.encode()
        folded = np.frombuffer(data.translate(_FOLD), np.uint8) != 0x20
        edges = np.flatnonzero(np.diff(np.concatenate(([False], folded, [False])).astype(np.int8))).reshape(-1, 2)
        kept, at = [], 0
        for span in spans:
            kept.append(data[at : edges[span["a"]][0]])
            at = edges[span["b"] - 1][1]
        out.append(b"".join([*kept, data[at:]]).decode())
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = 500_000) -> DataFrame:
    """All documents, without the hit words and what stands between them; columns stay."""
    found = find_hits(docs, benchmark, window, block_windows)
    text = _without(F.col("doc.text"), F.col("hits"))
    return found.select("doc", text.alias("clean")).select(
        *[F.col("clean").alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    )
