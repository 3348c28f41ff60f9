"""Near copies by SimHash fingerprints and BK-trees.

A document's fingerprint has a bit for each majority among the hashes of its four-word shingles.
Equal fingerprints become one row.  Two fingerprints that differ in at most ``radius`` of their 64
bits agree wholly on some of ``blocks`` bit blocks (all but ``radius`` of them); so each choice of
that many blocks, with their bits, is a shard, and linked fingerprints share a shard.  A shard holds
its fingerprints in a BK-tree: a child is keyed by its integer Hamming distance to its parent, and a
search follows only edges whose key is within ``radius`` of the distance at the node.

A shard is bounded by ``tree_size``.  A larger one is split into several trees by a hash; each of its
fingerprints is put in one tree and looked up in the trees before it, so no link is lost, and trees
are worked on by different tasks.  A tree and its searches meet by key; sending all trees to all
tasks would be a broadcast that grows with the data.  Only links that join two groups are passed on
(at most one per fingerprint of a tree), never all pairs.

Defined results: null and empty texts have fingerprint zero and are linked like others; a text of
fewer words than a shingle is one shingle; rows with equal ``doc_id`` each get a result; a null
``doc_id`` gets one too, and its group is named by the smallest ``doc_id`` that isn't null; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausetrail.llm.common import prepare, stage, text_bytes
from clausetrail.llm.components import components

BITS = 64


def fingerprint_of(data: bytes, words_per_shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text given as UTF-8 bytes."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    count = len(words) - words_per_shingle + 1
    if count <= 1:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: count - 1])).tolist()
    ends = (ends[words_per_shingle - 1 :] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, count)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(
            axis=0, dtype=np.int64
        )
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def _fingerprint_udf(words_per_shingle: int):
    @F.arrow_udf("bigint")
    def fingerprint(texts: pa.Array) -> pa.Array:
        found = [fingerprint_of(x.as_py(), words_per_shingle) for x in texts]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return fingerprint.asNondeterministic()  # evaluated once, also where a filter follows


def fingerprint_column(text: str = "text", words_per_shingle: int = 4) -> Column:
    """The fingerprint as a signed 64-bit number."""
    return _fingerprint_udf(words_per_shingle)(text_bytes(text))


class BKTree:
    """Fingerprints; each node is [value, {distance to it: child}]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            distance = (node[0] ^ value).bit_count()
            if not distance:
                return
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = [value, {}]
                return
            node = child

    def near(self, value: int, radius: int) -> list[int]:
        """All values within ``radius`` of this one."""
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            own, children = open_nodes.pop()
            distance = (own ^ value).bit_count()
            if distance <= radius:
                found.append(own)
            for key, child in children.items():
                if -radius <= key - distance <= radius:
                    open_nodes.append(child)
        return found


class Groups:
    """Union-find that tells which links joined two groups."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def tree_links(members: list[int], visitors: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within ``radius``: among a tree's members, and of its visitors to it."""
    tree, groups = BKTree(), Groups()
    for value in members:
        for other in tree.near(value, radius):
            groups.join(value, other)
        tree.add(value)
    for value in visitors:
        for other in tree.near(value, radius):
            groups.join(value, other)
    return [(x, root) for x in list(groups.parent) if (root := groups.find(x)) != x]


def blocks_for(count: int, radius: int, shard_size: int = 64) -> int:
    """Bit blocks to cut fingerprints into, so that shards of random ones hold few of them."""
    for blocks in range(radius + 1, 2 * radius + 5):
        if count <= shard_size << (BITS * (blocks - radius) // blocks):
            return blocks
    return 2 * radius + 4


def _block_keys(value: Column, radius: int, blocks: int) -> Column:
    """Array of one shard name for each choice of ``blocks - radius`` blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    keys = []
    for number, choice in enumerate(combinations(masks, blocks - radius)):
        mask = sum(choice)
        signed = mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask
        keys.append(F.xxhash64(F.lit(number), value.bitwiseAND(F.lit(signed).cast("bigint"))))
    return F.array(*keys)


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, visitors = None, [], []

        def linked() -> pa.RecordBatch:
            found = tree_links(members, visitors, radius) if len(members) + len(visitors) > 1 else []
            columns = [pa.array(np.array(side, np.uint64).view(np.int64)) for side in (list(zip(*found)) or [[], []])]
            return pa.RecordBatch.from_arrays(columns, names=["u", "v"])

        for batch in batches:
            shards, trees = (batch.column(i).to_pylist() for i in (0, 1))
            values = batch.column(2).to_numpy().view(np.uint64).tolist()
            for own, value, member in zip(zip(shards, trees), values, batch.column(3).to_pylist()):
                if own != key:
                    if members and (out := linked()).num_rows:
                        yield out
                    key, members, visitors = own, [], []
                (members if member else visitors).append(value)
        if members and (out := linked()).num_rows:
            yield out

    return run


def fingerprint_links(values: DataFrame, radius: int = 4, tree_size: int = 4096, blocks: int | None = None) -> DataFrame:
    """values: distinct fingerprints in ``fp``.  Returns links u, v that connect all within ``radius``.

    Visitors of a tree are cut into blocks of ``tree_size`` too, so a task holds two of these at most
    for a shard of any size.
    """
    prepare(values.sparkSession)
    blocks = blocks or blocks_for(values.count(), radius)
    keyed = values.select("fp", F.explode(_block_keys(F.col("fp"), radius, blocks)).alias("shard"))
    sizes = keyed.groupBy("shard").count().filter("count > 1")
    sized = keyed.join(sizes, "shard").withColumn(
        "trees", F.ceil(F.col("count") / F.lit(tree_size)).cast("int")
    )
    sized = sized.withColumn("own", F.pmod(F.xxhash64(F.lit("tree"), "fp"), F.col("trees")).cast("int"))
    # Tree t meets the block of values b >= t: (t, t) is the tree itself, (t, b) its visitors of block b.
    # Members of t stand in each of these, so a task of one pair needs no other task's tree.
    meetings = F.explode(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("own")), lambda t: F.struct(t.alias("t"), F.col("own").alias("b"), (t == F.col("own")).alias("member"))),
            F.when(
                F.col("own") + 1 < F.col("trees"),
                F.transform(
                    F.sequence(F.col("own") + 1, F.col("trees") - 1),
                    lambda b: F.struct(F.col("own").alias("t"), b.alias("b"), F.lit(True).alias("member")),
                ),
            ).otherwise(F.array().cast("array<struct<t:int,b:int,member:boolean>>")),
        )
    )
    met = sized.select("shard", "fp", meetings.alias("m")).select(
        "shard", (F.col("m.t") * F.lit(1 << 31).cast("bigint") + F.col("m.b")).alias("tree"), "fp", F.col("m.member").alias("member")
    )
    return (
        met.repartition("shard", "tree")
        .sortWithinPartitions("shard", "tree", "fp")
        .mapInArrow(_shard_links(radius), "u bigint, v bigint")
    )


def near_groups(prints: DataFrame, radius: int = 4, tree_size: int = 4096, blocks: int | None = None) -> DataFrame:
    """prints: doc_id and fp of every document.  Returns fp, root and component_id, one row per fingerprint.

    ``root`` names the group too, also where no document of it has an id.
    """
    firsts = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = components(fingerprint_links(firsts.select("fp"), radius, tree_size, blocks))
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(names, "root").select("fp", "root", "component_id")


def documents_with_groups(docs: DataFrame, radius: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prepare(docs.sparkSession)
    prints = stage(docs.select("doc_id", fingerprint_column("text", words_per_shingle).alias("fp")), "prints")
    return prints.join(near_groups(prints, radius), "fp")


def drop_near_copies(docs: DataFrame, radius: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """Keeps one row of each group: the one with the smallest ``doc_id``.

    Rows with that same ``doc_id`` are told apart by their whole content; of equal rows one stays.
    Nothing but ids, fingerprints and hashes is grouped; texts are joined in at the end.
    """
    prepare(docs.sparkSession)
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    numbered = stage(
        docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), whole.alias("whole"), fingerprint_column("text", words_per_shingle).alias("fp")).withColumn("row_number", F.monotonically_increasing_id()),
        "numbered",
    )
    prints = numbered.select(F.col("id").alias("doc_id"), "fp")
    groups = near_groups(prints, radius)
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "whole", "row_number")
    kept = (
        numbered.select("id", "whole", "row_number", "fp")
        .groupBy("fp")
        .agg(F.min(first).alias("first"))
        .join(groups, "fp")
        .groupBy("root")
        .agg(F.min("first").alias("first"))
        .select(F.col("first.row_number").alias("row_number"))
    )
    return numbered.join(kept, "row_number", "left_semi").select("doc.*")
