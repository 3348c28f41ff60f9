"""Maximal repeats by an enhanced suffix array, and texts without what an earlier document holds.

A repeat is a string of ``LEAST`` bytes or more that starts at two places.  Its groups are the nodes of the
common-prefix interval tree: suffixes are sorted, neighbours get their common prefix, a stack scan turns these into
intervals, and an interval whose suffixes differ in the byte before them (it can't be extended to the left) is a
maximal repeat with all its occurrences.

Suffixes of one array must share their first ``LEAST`` bytes to matter, so arrays are small and spread:

* Each window of ``LEAST`` bytes has an anchor, the ``GRAM``-byte string in it with the smallest hash.  Equal windows
  have equal anchors.  Successive windows with one anchor form a stretch, which is the unit that is dealt out.
* Texts are dealt into blocks, kept as a table bucketed by block, so that later steps bring small rows to the texts
  and never the texts to them.  Each block sends its distinct stretches as hashes, packed by bucket of the anchor.
  A bucket answers which stretches occur elsewhere, in a document with a smaller id, or beside others of that anchor.
* Equal stretches are one leaf of the tree, however many documents hold them.  Distinct stretches that share an anchor
  go, once each, to the anchor's suffix array.
* An anchor with more than ``crowd`` distinct stretches is not gathered: its windows are grouped by Spark instead,
  with partial sums, so a string that stands in a third of all documents is no single task.

A repeat that runs over several stretches comes out as one group for each; their spans overlap and are merged.

Defined results: null and empty texts have no byte; a null ``doc_id`` counts as the largest; rows with equal
``doc_id`` take nothing from one another, also where they are equal in all columns; texts are compared as UTF-8 bytes
and never across documents; a text under ``LEAST`` bytes stays whole; an empty table gives an empty result; other
columns, of any name, pass through ``remove_repeats`` untouched.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausetrail.llm.common import prepare, stage, text_bytes
from clausetrail.plans.stages import stage_root

LEAST, GRAM = 50, 20
BLOCK_BYTES, ENTRIES, CROWD = 8 << 20, 1 << 20, 4096
LAST_ID = (1 << 63) - 1
_SEGMENT, _TOGETHER = 1 << 22, 1 << 15
_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@cache
def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every string of ``size`` bytes, put together from those of 1, 2, 4, ... bytes."""
    part, width, out, done = _LETTERS[data], 1, None, 0
    while True:
        if size & width:
            if out is None:
                out = part
            else:
                out = out[: len(data) - done - width + 1] * _power(width)
                out += part[done : done + len(out)]
            done += width
        if done == size:
            return out
        longer = part[:-width] * _power(width)
        longer += part[width:]
        part, width = longer, 2 * width


def _smallest(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every ``size`` successive values."""
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text, start, end, anchor and hash of each stretch; its windows begin from start to end - LEAST."""
    found: list[tuple[np.ndarray, ...]] = [tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))]
    some: list[tuple[int, int, bytes]] = []  # text, place of this part in it, part
    size = 0
    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - LEAST + 1, 0), _SEGMENT):
            some.append((number, at, text[at : at + _SEGMENT + LEAST - 1]))
            size += len(some[-1][2])
            if size >= _TOGETHER:
                found.append(_stretches(some))
                some, size = [], 0
    if some:
        found.append(_stretches(some))
    return tuple(np.concatenate(x) for x in zip(*found))


def _stretches(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    number, at = (np.array(x, np.int64) for x in list(zip(*parts))[:2])
    sizes = np.array([len(x[2]) for x in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    grams = gram_hashes(np.frombuffer(b"".join(x[2] for x in parts), np.uint8), GRAM)
    low = np.uint64((1 << 24) - 1)
    # The place is in the low bits: of equal hashes the leftmost is the smallest.
    ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    place = (_smallest(ranked, LEAST - GRAM + 1) & low).astype(np.int64)
    new = np.empty(len(place), bool)
    new[0], new[1:] = True, place[1:] != place[:-1]
    new[begin] = True
    starts = np.flatnonzero(new)
    own = np.searchsorted(begin, starts, side="right") - 1
    last = begin[own] + sizes[own] - LEAST  # of the text's windows
    ends = np.minimum(np.concatenate((starts[1:] - 1, [len(place) - 1])), last) + LEAST
    inside = starts <= last
    starts, ends, own = starts[inside], ends[inside], own[inside]
    # Of four grams that cover the whole stretch, as it has 2 * LEAST - GRAM bytes at most.
    whole = (ends - starts).astype(np.uint64)
    for k, gram in enumerate((starts, starts + GRAM, ends - 2 * GRAM, ends - GRAM)):
        whole += grams[gram] * _power(101 + k)
    shift = at[own] - begin[own]
    return number[own], starts + shift, ends + shift, _mixed(grams[place[starts]]), _mixed(whole)


class Block:
    """The stretches of a block's texts, which come in order of ids, by bucket and key.

    A bucket is the leading ``bits`` of the anchor; a key has 24 more bits of it and 40 of the stretch's hash.
    """

    def __init__(self, ids: list[int], texts: list[bytes], bits: int) -> None:
        self.ids, self.texts = np.array(ids, np.int64), texts
        text, start, end, anchor, whole = stretches(texts)
        key = anchor << np.uint64(bits) >> np.uint64(40) << np.uint64(40) | whole >> np.uint64(24)
        bucket = (anchor >> np.uint64(64 - bits)).astype(np.uint32) if bits else np.zeros(len(key), np.uint32)
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(bucket[order].astype(np.uint16) if bits <= 16 else bucket[order], kind="stable")]
        self.text, self.start, self.end, self.anchor, self.whole = text[order], start[order], end[order], anchor[order], whole[order]
        key, bucket = key[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
        self.first = np.flatnonzero(new)  # of each distinct stretch, the place with the smallest id
        self.kind = np.cumsum(new) - 1  # which distinct stretch each is
        self.again = np.bincount(self.kind, minlength=len(self.first)) > 1
        self.keys, self.bucket = key[self.first], bucket[self.first]

    def cells(self) -> Iterator[tuple[int, slice]]:
        """Each bucket with its distinct stretches."""
        edges = np.concatenate(([0], np.flatnonzero(np.diff(self.bucket)) + 1, [len(self.bucket)])).tolist()
        for a, b in zip(edges, edges[1:]):
            if a < b:
                yield int(self.bucket[a]), slice(a, b)


def _sent(bits: int):
    """Block, bucket, keys of stretches, the texts they are first in, and the ids of these."""

    def run(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        block, out = Block(table["id"].to_pylist(), table["data"].to_pylist(), bits), []
        for b, cell in block.cells():
            texts, number = np.unique(block.text[block.first[cell]], return_inverse=True)
            parts = block.keys[cell], number.astype(np.uint32 if len(texts) > 65535 else np.uint16), block.ids[texts]
            out.append((table["block"][0].as_py(), b, *(x.tobytes() for x in parts)))
        kinds = [("block", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "numbers", "ids"))]
        return pa.table([pa.array(x, t) for x, (_, t) in zip(list(zip(*out)) or [[]] * 5, kinds)], names=[k for k, _ in kinds])

    return run


SENT = "block bigint, bucket int, keys binary, numbers binary, ids binary"
REPEATED, EARLIER, BESIDE, CROWDED, OWNER = 1, 2, 4, 8, 16


def _answers(crowd: int):
    """For each cell of a bucket a byte for each stretch, of the flags above."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
        ids = []
        for r in rows:
            known = np.frombuffer(r["ids"], np.int64)
            ids.append(known[np.frombuffer(r["numbers"], np.uint32 if len(known) > 65535 else np.uint16)])
        edges = np.cumsum([0, *map(len, keys)])
        key, own = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        kind = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        fresh = np.ones(len(first), bool)
        fresh[1:] = key[first[1:]] >> np.uint64(40) != key[first[:-1]] >> np.uint64(40)
        group = np.cumsum(fresh) - 1
        beside = np.bincount(group)[group][kind]
        flags = (np.bincount(kind)[kind] > 1) * REPEATED | (own > own[first][kind]) * EARLIER
        flags |= (beside > 1) * BESIDE | (beside > crowd) * CROWDED | new * OWNER
        out = np.empty(len(key), np.uint8)
        out[order] = flags
        said = pa.array([out[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
        return pa.table([table["block"], table["bucket"], said], names=["block", "bucket", "flags"])

    return run


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("id", "ascending"), ("row", "ascending")])


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of their starts, with those that touch joined."""
    reach = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    return starts[new], reach[np.concatenate((new[1:] - 1, [len(ends) - 1]))]


FOUND = "kind string, block bigint, row bigint, id bigint, start bigint, end bigint, anchor bigint, whole bigint, piece binary"


def _found(bits: int, every: bool):
    """Of a block: spans that an earlier document holds as whole stretches; distinct stretches to compare with others,
    and where these stand in the documents that hold them first.

    ``every``: also each occurrence of each repeated stretch, under its name (anchor, whole).
    """

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _ordered(texts)
        name, rows = texts["block"][0].as_py(), texts["row"].to_numpy()
        block = Block(texts["id"].to_pylist(), texts["data"].to_pylist(), bits)
        flags = np.zeros(len(block.first), np.uint8)
        said = dict(zip(answers["bucket"].to_pylist(), answers["flags"].to_pylist()))
        for b, cell in block.cells():
            flags[cell] = np.frombuffer(said[b], np.uint8)
        own = block.ids[block.text]
        held = (flags[block.kind] & EARLIER > 0) | (own > own[block.first][block.kind])
        out = []

        def put(kind: str, at: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, named: bool = True, pieces: list[bytes] | None = None) -> None:
            names = [pa.array(x[at].view(np.int64)) if named else pa.nulls(len(text), pa.int64()) for x in (block.anchor, block.whole)]
            whole = pa.array(pieces, pa.binary()) if pieces is not None else pa.nulls(len(text), pa.binary())
            kinds, blocks = (pa.array([x]).take(pa.array(np.zeros(len(text), np.int64))) for x in (kind, name))
            columns = [kinds, blocks, pa.array(rows[text]), pa.array(block.ids[text]), pa.array(start), pa.array(end), *names, whole]
            out.append(pa.table(columns, names=[x.split()[0] for x in FOUND.split(", ")]))

        # Texts follow one another on one line, so that runs of all of them are found at once.
        picked = np.flatnonzero(held)
        long = np.int64(max(map(len, block.texts)) + 1)
        line = block.text[picked] * long + block.start[picked]
        order = np.argsort(line)
        if len(picked):
            begin, end = _runs(line[order], line[order] + (block.end - block.start)[picked][order])
            put("span", picked, begin % long, begin % long + end - begin, begin // long, named=False)
        beside = flags & BESIDE > 0
        for kind, crowded in (("piece", False), ("crowded", True)):
            at = block.first[beside & (flags & OWNER > 0) & ((flags & CROWDED > 0) == crowded)]
            text, start, end = block.text[at], block.start[at], block.end[at]
            put(kind, at, start, end, text, pieces=[block.texts[t][a:b] for t, a, b in zip(text.tolist(), start.tolist(), end.tolist())])
        for kind, at in (("first", np.flatnonzero(~held & beside[block.kind])), ("place", np.flatnonzero((flags & (REPEATED | BESIDE) > 0)[block.kind] | block.again[block.kind]))):
            if kind == "first" or every:
                put(kind, at, block.start[at], block.end[at], block.text[at])
        return pa.concat_tables(out)

    return run


class SuffixArray:
    """Suffixes, from each window start, of pieces (distinct stretches); ``lcp[i]`` is shared by suffixes i - 1 and i."""

    def __init__(self, pieces: list[bytes]) -> None:
        lengths = np.array([len(p) for p in pieces], np.int64)
        room = int(lengths.max()) + 8
        joined = np.frombuffer(b"".join(pieces) + bytes(room), np.uint8)
        begin = np.cumsum(lengths) - lengths
        windows = lengths - LEAST + 1
        piece = np.repeat(np.arange(len(pieces)), windows)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
        # Only suffixes whose first LEAST bytes occur again can be in an interval.
        key = gram_hashes(joined, LEAST)[begin[piece] + offset]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        self.piece, self.offset = piece[order], offset[order]
        at, self.length = begin[self.piece] + self.offset, lengths[self.piece] - self.offset
        width = -(-int(self.length.max(initial=LEAST)) // 8) * 8
        letters = np.lib.stride_tricks.sliding_window_view(joined, width)[at]
        letters[np.arange(width) >= self.length[:, None]] = 0
        words = letters.view(">u8").astype(np.uint64)
        order = np.lexsort((self.piece, self.length, *words.T[::-1]))
        self.piece, self.offset, self.length, at, letters = self.piece[order], self.offset[order], self.length[order], at[order], letters[order]
        self.before = np.where(self.offset > 0, joined[at - 1].astype(np.int64), -1 - np.arange(len(at)))
        self.lcp = np.zeros(len(at) + 1, np.int64)
        if len(at) > 1:
            differ = letters[1:] != letters[:-1]
            shared = np.where(differ.any(1), differ.argmax(1), width)
            self.lcp[1:-1] = np.minimum(shared, np.minimum(self.length[1:], self.length[:-1]))

    def intervals(self) -> Iterator[tuple[int, int, int]]:
        """(length, first, last) of each node of the common-prefix interval tree that can't be extended to the left."""
        # Suffixes up to the one at ``change[i]`` have the byte before them in common with the one at i.
        lcp, change = self.lcp.tolist(), np.zeros(len(self.before), np.int64)
        if len(change):
            differs = np.concatenate(([True], self.before[1:] != self.before[:-1]))
            change = np.maximum.accumulate(np.where(differs, np.arange(len(change)), 0))
        change = change.tolist()
        stack: list[tuple[int, int]] = []
        for i in range(1, len(lcp)):
            left, depth = i - 1, lcp[i]
            while stack and stack[-1][0] > depth:
                length, left = stack.pop()
                if change[i - 1] > left:
                    yield length, left, i - 1
            if depth >= LEAST and (not stack or stack[-1][0] < depth):
                stack.append((depth, left))


def _in_order(some: int, each):
    """Calls ``each`` with the rows of whole anchors, about ``some`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= some:
                table = pa.Table.from_batches(waiting)
                anchors = table["anchor"].to_numpy()
                cut = int(np.flatnonzero(anchors != anchors[-1])[-1]) + 1 if anchors[0] != anchors[-1] else 0
                if cut:
                    yield from each(table.slice(0, cut)).to_batches()
                    waiting = table.slice(cut).combine_chunks().to_batches()
        if waiting:
            yield from each(pa.Table.from_batches(waiting)).to_batches()

    return run


def _later_spans(table: pa.Table) -> pa.Table:
    """Spans, within their stretches, that a stretch of a smaller id holds too."""
    ids = table["id"].to_numpy()
    array = SuffixArray(table["piece"].to_pylist())
    found = []
    for length, first, last in array.intervals():
        members = array.piece[first : last + 1]
        own = ids[members]
        late = own > own.min()
        if late.any():
            at = array.offset[first : last + 1][late]
            found.append((members[late], at, at + length))
    picked, begin, end = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    named = [table[c].take(pa.array(picked)) for c in ("anchor", "whole")]
    return pa.table([*named, pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["anchor", "whole", "from", "to"])


def _interval_rows(table: pa.Table) -> pa.Table:
    """Group (its first suffix: anchor, whole, offset), length, and the members: pieces and offsets in these."""
    array = SuffixArray(table["piece"].to_pylist())
    anchor, whole = table["anchor"].to_numpy(), table["whole"].to_numpy()
    out = []
    for length, first, last in array.intervals():
        members, offsets = array.piece[first : last + 1], array.offset[first : last + 1]
        name = min(zip(anchor[members].tolist(), whole[members].tolist(), offsets.tolist()))
        out += [(f"{name[0]}:{name[1]}:{name[2]}:{length}", length, a, w, o) for a, w, o in zip(anchor[members].tolist(), whole[members].tolist(), offsets.tolist())]
    kinds = (pa.string(), *(pa.int64(),) * 4)
    return pa.table([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 5, kinds)], names=["group", "length", "anchor", "whole", "offset"])


class Texts:
    """The texts of ``docs`` in blocks (a bucketed table), and what was found in them."""

    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES, entries: int = ENTRIES, crowd: int = CROWD, every: bool = False) -> None:
        spark = self.spark = docs.sparkSession
        prepare(spark)
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(1, math.ceil(total / block_bytes))
        self.buckets = max(1, math.ceil(blocks / 2))
        bits = max(0, math.ceil(math.log2(max(1, total * 0.07 / entries))))
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("id"), F.struct("*").alias("doc"))
        blocked = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
        self.name = f"blocks_{uuid.uuid4().hex}"
        writer = blocked.repartition(self.buckets, "block").write.bucketBy(self.buckets, "block").sortBy("block", "row")
        writer.option("path", f"{stage_root(spark)}/{self.name}").option("compression", "zstd").saveAsTable(self.name)
        texts = self.table().select("block", "row", "id", text_bytes("doc.text").alias("data"))
        sent = texts.groupBy("block").applyInArrow(_sent(bits), SENT)
        answers = sent.groupBy("bucket").applyInArrow(_answers(crowd), "block bigint, bucket int, flags binary")
        found = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_found(bits, every), FOUND)
        self.found = stage(found, "stretches")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def pieces(self) -> DataFrame:
        rows = self.found.filter("kind = 'piece'").select("anchor", "whole", "id", "piece")
        return rows.repartition("anchor").sortWithinPartitions("anchor")

    def crowded(self) -> DataFrame:
        """Every window of the pieces of crowded anchors, as a row of its own."""
        rows = self.found.filter("kind = 'crowded'").withColumn("offset", F.explode(F.sequence(F.lit(0), F.octet_length("piece") - LEAST)))
        return rows.withColumn("window", F.substring("piece", F.col("offset") + 1, F.lit(LEAST)))

    def spans(self) -> DataFrame:
        """block, row, start, end of what a document with a smaller id holds; spans may overlap."""
        whole = self.found.filter("kind = 'span'").select("block", "row", "start", "end")
        apart = self.pieces().mapInArrow(_in_order(20_000, _later_spans), "anchor bigint, whole bigint, from bigint, to bigint")
        windows = self.crowded()
        first = windows.groupBy("window").agg(F.min("id").alias("low"))
        late = windows.join(first, "window").filter("id > low")
        crowded = late.select("anchor", "whole", F.col("offset").cast("bigint").alias("from"), (F.col("offset") + LEAST).cast("bigint").alias("to"))
        firsts = self.found.filter("kind = 'first'").select("anchor", "whole", "block", "row", "start")
        met = firsts.join(apart.unionByName(crowded), ["anchor", "whole"])
        return whole.unionByName(met.select("block", "row", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end")))


def maximal_repeats(docs: DataFrame, **limits: int) -> DataFrame:
    """Groups of repeats with all their occurrences: group, length, doc_id, row (of the table), start (in bytes)."""
    texts = Texts(docs, every=True, **limits)
    places = texts.found.filter("kind = 'place'").select("anchor", "whole", "row", "id", "start", "end")
    again = places.groupBy("anchor", "whole").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    equal = places.join(again, ["anchor", "whole"]).select(
        F.concat_ws(":", "anchor", "whole").alias("group"), (F.col("end") - F.col("start")).alias("length"), "id", "row", "start"
    )
    members = texts.pieces().mapInArrow(_in_order(20_000, _interval_rows), "group string, length bigint, anchor bigint, whole bigint, offset bigint")
    windows = texts.crowded().select("window", "anchor", "whole", "offset")
    shared = windows.groupBy("window").count().filter("count > 1").select("window")
    crowded = windows.join(shared, "window").select(F.hex("window").alias("group"), F.lit(LEAST).cast("bigint").alias("length"), "anchor", "whole", "offset")
    met = members.unionByName(crowded).join(places.select("anchor", "whole", "row", "id", "start"), ["anchor", "whole"])
    parts = met.select("group", "length", "id", "row", (F.col("start") + F.col("offset")).alias("start"))
    return equal.unionByName(parts).select("group", "length", F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "row", "start")


def kept_parts(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """The text without its spans, the bytes removed, and the number of maximal runs removed."""
    if not len(starts):
        return data, 0, 0
    order = np.argsort(starts, kind="stable")
    first, last = (x.tolist() for x in _runs(starts[order], ends[order]))
    kept = b"".join(data[a:b] for a, b in zip([0, *last], [*first, len(data)]))
    return kept, len(data) - len(kept), len(first)


def _cut(digest: bool):
    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        row, start, end = (spans[c].to_numpy() for c in ("row", "start", "end"))
        order = np.argsort(row, kind="stable")
        row, start, end = row[order], start[order], end[order]
        out = []
        for own, doc_id, data in zip(*(texts[c].to_pylist() for c in ("row", "doc_id", "data"))):
            part = slice(*np.searchsorted(row, [own, own + 1]))
            kept, removed, runs = kept_parts(data, start[part], end[part])
            out.append((own, doc_id, len(data), removed, runs, hashlib.sha256(kept).hexdigest(), None if digest else kept))
        kinds = (*(pa.int64(),) * 5, pa.string(), pa.binary())
        names = ["row", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.table([texts["block"], *(pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 7, kinds))], names=["block", *names])

    return run


def _results(texts: Texts, digest: bool) -> DataFrame:
    rows = texts.table().select("block", "row", F.col("doc.doc_id").cast("bigint").alias("doc_id"), text_bytes("doc.text").alias("data"))
    schema = "block bigint, row bigint, doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return rows.groupBy("block").cogroup(texts.spans().groupBy("block")).applyInArrow(_cut(digest), schema)


def removals(docs: DataFrame, **limits: int) -> DataFrame:
    """Per document: its bytes, those removed, the runs they form, and the digest of what stays."""
    texts = Texts(docs.select("doc_id", "text"), **limits)
    return _results(texts, True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, **limits: int) -> DataFrame:
    """The documents, each text without the bytes that documents with smaller ids hold.

    Where a removal splits a character, its remaining bytes become replacement characters; null texts stay null.
    """
    texts = Texts(docs, **limits)
    kept = texts.table().join(_results(texts, False).select("block", "row", "n_removed", "kept"), ["block", "row"])
    text = F.when(F.col("n_removed") > 0, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col("doc.text"))
    return kept.select(*[text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
