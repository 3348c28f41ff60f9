"""Near copies by exact similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two sides, and each is compared by whole sets before it links anything:

* Fingerprints of five-word shingles and their BK-trees (``simhash``) give the bulk: most copies differ in a few of 64 bits.
* At 0.8 two fingerprints differ in about 10 bits, often in 15, and no cut into bit blocks is selective at such a radius.
  What they miss comes from prefixes: with the shingles of all texts in one order, two sets that are similar enough
  share a shingle among the first ``n - ceil(similarity * n) + 1`` of each.  Any order gives all pairs; rare shingles
  first gives few candidates.  All shingles of all texts are counted for this, by slices of their hashes, so that versions of
  a text that differ too much mostly begin with shingles of their own, however many versions there are.  A shingle of one
  text alone is not sent anywhere.

Only texts that aren't linked yet are candidates.  In each of some rounds every shingle with two groups compares all its
texts with one of them, the pivot, which then leaves; linked groups are found again.  What is apart after the rounds is
compared pair by pair, so no link is lost.  Pairs are told apart before their texts are sent, by where they share their first
shingle and, after the rounds, by signatures that tell how many shingles they can't share; neither drops a pair that is similar.

Texts with equal sets are one node.  The texts are kept as a table bucketed by node, so they are dealt out once; a
comparison sends the text of a node to its pivot, once for each pivot, and the pivot's to each task that needs it.

Defined results: null and empty texts have equal (empty) sets; a text of fewer words than a shingle is one shingle;
words are split at ASCII white space, and only A-Z are folded; shingles are compared by 64-bit hashes; of a group the
row with the smallest ``doc_id`` stays, null last, then by whole content, and one of equal rows; other columns, of any
name, are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausetrail.llm.common import prepare, stage, text_bytes
from clausetrail.llm.components import components
from clausetrail.llm.simhash import fingerprint_column, fingerprint_links
from clausetrail.plans.stages import discard, stage_root

WORDS, SIMILARITY = 5, 0.8
SAMPLE, COMMON = 2_000, 8
SIGNATURE = 1024
PARITIES = [f"s{i}" for i in range(SIGNATURE // 64)]


def shingles(data: bytes, words_per_shingle: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text given as UTF-8 bytes, in order."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    count = len(words) - words_per_shingle + 1
    if count <= 1:
        return np.array([xxh64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: count - 1])).tolist()
    ends = (ends[words_per_shingle - 1 :] - 1).tolist()
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b]) for a, b in zip(starts, ends)), np.uint64, count))


def similar(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * least.denominator >= (len(a) + len(b) - shared) * least.numerator


def prefix(own: np.ndarray, levels: np.ndarray, least: Fraction) -> np.ndarray:
    """Places of the shingles by which a set is looked up, the rarest first."""
    n = len(own)
    return np.lexsort((own, levels))[: n + int(-n * least // 1) + 1 if n else 0]


def _nodes(words: int):
    @F.arrow_udf("bigint")
    def node(texts: pa.Array) -> pa.Array:
        from xxhash import xxh3_64_intdigest

        found = [xxh3_64_intdigest(shingles(x.as_py(), words).tobytes()) for x in texts]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return node.asNondeterministic()


def _planes(values: np.ndarray) -> bytes:
    """The numbers byte by byte of equal weight, so that high bytes without a value take no room on disk."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _cells(words: int, bits: int, most: int = 2000, most_bytes: int = 2 << 20):
    """Packs of texts: for each slice of the hashes the cells of their shingles, and to which text of the pack each belongs.

    A slice is told by the first ``bits`` bits of a hash, a cell in it by the next 24.  One row of a pack names its nodes.
    """

    def packed(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        from xxhash import xxh3_64_intdigest

        named = np.array(nodes, np.int64).tobytes()
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        slice_of = (every >> np.uint64(64 - bits)).astype(np.int64)
        cell = ((every >> np.uint64(64 - bits - 24)) & np.uint64((1 << 24) - 1)).astype(np.uint32)
        order = np.argsort(slice_of, kind="stable")
        slice_of, cell, owner = slice_of[order], cell[order], owner[order]
        starts = np.flatnonzero(np.diff(slice_of, prepend=-1))
        spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]))
        columns = [
            pa.array([np.uint64(xxh3_64_intdigest(named)).view(np.int64)] * len(spans), pa.int64()),
            pa.array(slice_of[starts].astype(np.int32)),
            pa.array([b"" if at else named for at in range(len(spans))], pa.binary()),
            pa.array([_planes(np.diff(owner[a:b], prepend=0).astype(np.uint16)) for a, b in spans], pa.binary()),
            pa.array([_planes(cell[a:b]) for a, b in spans], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["pack", "slice", "nodes", "owners", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, held = [], [], 0
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py()
                nodes.append(node)
                sets.append(shingles(data, words))
                held += len(data)
                if len(nodes) >= most or held >= most_bytes:
                    yield packed(nodes, sets)
                    nodes, sets, held = [], [], 0
        if nodes:
            yield packed(nodes, sets)

    return run


PACKED = "pack bigint, slice int, nodes binary, owners binary, cells binary"


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of slice: instead of its cell the level of each shingle, from how many sets have the cell."""

    def counted(rows: list[dict]) -> pa.RecordBatch:
        own = [_numbers(row["cells"], np.uint32) for row in rows]
        every = np.sort(np.concatenate(own))
        starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        values, level = every[starts], np.ceil(np.log2(np.diff(starts, append=len(every)))).astype(np.uint8)
        found = [{**row, "cells": level[np.searchsorted(values, cells)].tobytes()} for row, cells in zip(rows, own)]
        return pa.RecordBatch.from_pylist(found, schema=schema)

    rows: list[dict] = []
    for batch in batches:
        schema = batch.schema
        for row in batch.to_pylist():
            if rows and row["slice"] != rows[0]["slice"]:
                yield counted(rows)
                rows = []
            rows.append(row)
    if rows:
        yield counted(rows)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of pack and slice: the levels of each text, in order of its shingles."""

    def divided(rows: list[dict]) -> pa.RecordBatch:
        nodes = np.frombuffer(b"".join(row["nodes"] for row in rows), np.int64)
        owner = np.concatenate([np.cumsum(_numbers(row["owners"], np.uint16), dtype=np.int64) for row in rows])
        levels = np.frombuffer(b"".join(row["cells"] for row in rows), np.uint8)[np.argsort(owner, kind="stable")]
        ends = np.cumsum(np.bincount(owner, minlength=len(nodes)))
        parts = [x.tobytes() for x in np.split(levels, ends[:-1])]
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(parts, pa.binary())], names=["node", "levels"])

    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["pack"] != rows[0]["pack"]:
                yield divided(rows)
                rows = []
            rows.append(row)
    if rows:
        yield divided(rows)


def shingle_levels(texts: DataFrame, words: int, per_task: int) -> DataFrame:
    """texts: node and data.  Returns node and levels: a byte for each shingle, in order of the hashes.

    Level 0 is a shingle of one set alone; level k stands for 2 ** (k - 1) + 1 to 2 ** k sets.  Hashes are counted by cells, of
    which there are many more than shingles: a shingle may be taken for more common than it is, never for rarer.
    """
    bits = max(4, (texts.select("node").count() // per_task).bit_length())
    cells = texts.select("node", "data").mapInArrow(_cells(words, bits), PACKED)
    counted = cells.repartition("slice").sortWithinPartitions("slice").mapInArrow(_levels, PACKED)
    return counted.repartition("pack").sortWithinPartitions("pack", "slice").mapInArrow(_marks, "node bigint, levels binary")


def _prefixes(words: int, least: Fraction):
    """Rows for the looked-up shingles that stand in other sets too; those of very many are told apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for node, root, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                own, levels = shingles(text.as_py(), words), np.frombuffer(marks.as_py() or b"", np.uint8)
                first = prefix(own, levels, least)
                pos = np.flatnonzero(levels[first]).astype(np.int32)
                at, size = first[pos], len(pos)
                out.append((own[at].view(np.int64), np.full(size, node), np.full(size, root), np.full(size, len(own), np.int32), pos, levels[at] > COMMON))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["key", "node", "root", "n", "pos", "hot"])

    return run


KEYED = "key bigint, node bigint, root bigint, n int, pos int"


def _shared(most: int = 1 << 16):
    """Rows in order of key: those of keys that stand in texts of two groups, and all that are known to be common.

    The rows of the last key wait for the next batch; a key with more than ``most`` of them passes through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        passing: int | None = None

        def kept(table: pa.Table) -> pa.Table:
            key, root, hot = (table[c].to_numpy() for c in ("key", "root", "hot"))
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            run_of = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
            apart = (np.maximum.reduceat(root, starts) != np.minimum.reduceat(root, starts))[run_of]
            keep = apart | hot | (key == passing if passing is not None else False)
            return table.filter(pa.array(keep)).drop_columns(["hot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            held += batch.num_rows
            last = batch.column(0)[-1].as_py()
            table = pa.Table.from_batches(waiting)
            cut = int(np.searchsorted(table["key"].to_numpy(), last))
            if held - cut > most:
                passing = last
                yield from kept(table).to_batches()
                waiting, held = [], 0
            elif cut:
                yield from kept(table.slice(0, cut)).to_batches()
                waiting = table.slice(cut).combine_chunks().to_batches()
                held -= cut
                passing = passing if passing == last else None
        if waiting:
            yield from kept(pa.Table.from_batches(waiting)).to_batches()

    return run


def _possible(least: Fraction, n: Column, pos: Column, other_n: Column, other_pos: Column) -> Column:
    """Whether sets of these sizes can be similar whose first shared shingle is at these positions.

    What two sets share comes at that shingle or after it, in either of them.  Pairs are met at each shingle they share, so
    also at the first one; others need not let them through.
    """
    shared = F.least(n - pos, other_n - other_pos)
    return shared * (least.numerator + least.denominator) >= (n + other_n) * least.numerator


def _signatures(words: int):
    """For each text the parities of how many of its shingles have each ending of ``SIGNATURE`` values, as numbers of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [(shingles(text.as_py(), words) & np.uint64(SIGNATURE - 1)).astype(np.int64) for text in batch.column(1)]
            odd = [np.packbits(np.bincount(x, minlength=SIGNATURE) & 1).view(np.int64) for x in ends]
            found = np.array(odd, np.int64).reshape(-1, SIGNATURE // 64).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], names=["node", *PARITIES])

    return run


def _not_too_different(least: Fraction, n: Column, signature: str, other_n: Column, other_signature: str) -> Column:
    """Whether sets of these sizes and signatures can be similar: each odd place that one has alone is a shingle not shared."""
    apart = sum((F.bit_count(F.col(f"{signature}.{x}").bitwiseXOR(F.col(f"{other_signature}.{x}"))) for x in PARITIES), F.lit(0))
    return (n + other_n - apart) * (least.numerator + least.denominator) >= 2 * (n + other_n) * least.numerator


def _alike(words: int, least: Fraction):
    """Rows of a pivot and part, the pivot's own first: the pairs that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            out = []
            for pivot, part, node, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                found = shingles(text.as_py(), words)
                if (pivot, part) != key:
                    key, own = (pivot, part), found
                elif node != pivot and similar(own, found, least):
                    out.append((pivot, node))
            u, v = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: Fraction, per_task: int = 2000) -> DataFrame:
    """The pairs (pivot, node) whose whole sets are similar, as u, v.  A pivot of many pairs is sent to several tasks."""
    pairs = pairs.filter("pivot <> node").distinct()
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(per_task)).cast("int").alias("parts"))
    members = pairs.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
    pivots = sizes.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("node"))
    met = texts.join(members.unionByName(pivots), "node").select("pivot", "part", "node", "data")
    placed = met.repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.desc(F.col("node") == F.col("pivot")))
    return stage(placed.mapInArrow(_alike(words, least), "u bigint, v bigint"), "verified")


def fingerprint_candidates(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """nodes: node, fp.  Pairs (pivot, node) that the BK-trees of fingerprints put together."""
    firsts = stage(nodes.groupBy("fp").agg(F.min("node").alias("pivot")), "fingerprints")
    equal = nodes.join(firsts, "fp").select("pivot", "node")
    roots = components(fingerprint_links(firsts.select("fp"), radius))
    names = firsts.select(F.col("fp").alias("root"), F.col("pivot").alias("first"))
    linked = firsts.join(roots.withColumnRenamed("node", "fp"), "fp").join(names, "root")
    return equal.unionByName(linked.select(F.col("first").alias("pivot"), F.col("pivot").alias("node"))).filter("pivot <> node")


def similar_nodes(
    texts: DataFrame, candidates: DataFrame | None = None, similarity: float = SIMILARITY, words: int = WORDS, small: int = 4, rounds: int = 3, sample: int = SAMPLE
) -> DataFrame:
    """texts: node and data (UTF-8), one row for each node.  Returns node, root of linked nodes.

    ``candidates``: pairs (pivot, node) to compare before any others.  ``sample``: of about so many texts one task counts the
    shingles, those of its share of the hashes; this and the other numbers change work, never results.
    """
    prepare(texts.sparkSession)
    least = Fraction(str(similarity))
    none = texts.sparkSession.createDataFrame([], "u bigint, v bigint")
    links = none if candidates is None else _verified(candidates, texts, words, least)
    roots = stage(components(links), "roots")
    rooted = texts.join(roots, "node", "left").join(shingle_levels(texts, words, sample), "node", "left")
    rooted = rooted.select("node", F.coalesce("root", "node").alias("root"), "data", "levels")
    keyed = rooted.mapInArrow(_prefixes(words, least), KEYED + ", hot boolean")
    # Keys known to be common only pass through, so they are spread.
    spread = keyed.repartition("key", F.when(F.col("hot"), F.pmod("node", F.lit(1024))))
    hot = stage(spread.sortWithinPartitions("key").mapInArrow(_shared(), KEYED), "shared")
    for turn in range(rounds + 1):
        # Few shingles of its own before this one: the text that most others can be similar to.
        pivot = F.min(F.struct("pos", F.xxhash64("root").alias("h"), "node", "root", "n")).alias("pivot")
        groups = hot.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), pivot)
        met = stage(hot.join(groups.filter("low < high").select("key", "size", "pivot"), "key"), "groups")
        discard(hot)
        if met.isEmpty():
            return roots
        whole = F.col("size") <= (small if turn < rounds else 1 << 62)
        near = _possible(least, F.col("n"), F.col("pos"), F.col("pivot.n"), F.col("pivot.pos"))
        to_pivot = met.filter(~whole & (F.col("root") != F.col("pivot.root")) & near).select("pivot.node", F.col("node").alias("other"))
        left = met.filter(whole).select("key", "node", "root", "n", "pos")
        if turn == rounds:  # Groups of any size: only these need signatures.
            own = texts.join(left.select("node").distinct(), "node").select("node", "data")
            signed = own.mapInArrow(_signatures(words), ", ".join(["node bigint", *(f"{x} bigint" for x in PARITIES)]))
            left = stage(left.join(signed.select("node", F.struct(*PARITIES).alias("signature")), "node"), "signed")
        right = left.select(*[F.col(c).alias(c if c == "key" else f"other_{c}") for c in left.columns])
        near = _possible(least, F.col("n"), F.col("pos"), F.col("other_n"), F.col("other_pos"))
        if turn == rounds:
            near &= _not_too_different(least, F.col("n"), "signature", F.col("other_n"), "other_signature")
        crossed = left.join(right, "key").filter((F.col("node") < F.col("other_node")) & (F.col("root") != F.col("other_root")) & near)
        pairs = to_pivot.toDF("pivot", "node").unionByName(crossed.select(F.col("node").alias("pivot"), F.col("other_node").alias("node")))
        links = links.unionByName(_verified(pairs, texts, words, least))
        roots = stage(components(links), "roots")
        rest = met.filter(~whole & (F.col("node") != F.col("pivot.node"))).select("key", "node", "n", "pos")
        hot = stage(rest.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "n", "pos"), "rest")
        discard(met)
    return roots


BUCKET_BYTES = 4 << 20


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, radius: int = 4, **limits: int) -> DataFrame:
    """Keeps one row of each group of linked texts: the one with the smallest ``doc_id``.

    Rows with that same ``doc_id`` are told apart by their whole content; of equal rows one stays.
    """
    spark = docs.sparkSession
    prepare(spark)
    data = text_bytes("text")
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    numbered = docs.select(
        F.struct("*").alias("doc"),
        F.col("doc_id").alias("id"),
        whole.alias("whole"),
        _nodes(words)(data).alias("node"),
        fingerprint_column("text", words).alias("fp"),
        F.monotonically_increasing_id().alias("row_number"),
    )
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # With fewer buckets than a join has partitions Spark would deal the texts out again for each join.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_BYTES))
    name = f"texts_{uuid.uuid4().hex}"
    writer = numbered.repartition(buckets, "node").write.bucketBy(buckets, "node").sortBy("node")
    writer.option("path", f"{stage_root(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "whole", "row_number")
    nodes = stage(table.groupBy("node").agg(F.min(first).alias("first"), F.min("fp").alias("fp")), "nodes")
    # Of rows with equal sets one stands for all.  Joins are by node alone, by which the table is bucketed; an equality of row
    # numbers would become a key of theirs, and all texts would be dealt out again.
    is_one = F.col("row_number").between(F.col("one"), F.col("one"))
    ones = nodes.select("node", F.col("first.row_number").alias("one"))
    texts = table.join(ones, "node").filter(is_one).select("node", text_bytes("doc.text").alias("data"))
    roots = similar_nodes(texts, fingerprint_candidates(nodes.select("node", "fp"), radius), similarity, words, **limits)
    named = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept = named.agg(F.min(F.struct("first", "node")).alias("kept")).select("kept.node", F.col("kept.first.row_number").alias("one"))
    return table.join(kept, "node").filter(is_one).select("doc.*")
