"""Spelling variants: words that one inserted, deleted or replaced letter turns into one another.

One edit changes few letter counts: a replaced letter lowers one count and raises another by one, an added letter
raises one.  So words are points of letter counts in k-d trees, one for each length, and a word is searched for in the
trees of its own length (one count up and one down at most) and of the next smaller (one down).  A search goes to the far
side of a split only while such a change is left; the words of the leaves it reaches are compared letter by letter.

The upper levels of the trees are fitted on a bounded sample (``sample`` words) and deal words to cells; a word
lives in one cell and visits every cell that its box meets, so the sample changes balance, never results.  A cell that
still has more than ``cell_size`` words, as many words can have equal counts, is dealt out again by a hash, and visitors go
to each part.  A task holds the words of one part in a tree of its own and streams the visitors past it.  Only counts and
the best neighbour of each word leave the cells, never pairs.

Words are counted per task first; of a text only its own distinct words are held.

Defined results: null and empty texts have no word; a null ``doc_id`` counts as an empty string in the seed of
``damaged_counts``; words are runs of ``[A-Za-z\\u00C0-\\u00FF]`` with only A-Z lower-cased; repeated rows count again;
of neighbours with equal counts the smallest in code-point order is the form; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausetrail.llm.common import prepare, stage, text_bytes

LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
CELL_SIZE, SAMPLE, LEAF = 4096, 50_000, 24
EVERY = 199
_LONG = 1 << 22
_SIMPLE = re.compile(rb"[a-z]{%d,}" % LEAST_LETTERS)
_ANY = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS)


def _runs(data: bytes) -> Counter:
    """The runs of LEAST_LETTERS letters or more of a text, as bytes."""
    lowered = data.lower()  # bytes: only A-Z change
    if lowered.isascii():
        return Counter(_SIMPLE.findall(lowered) if len(data) < _LONG else (m[0] for m in _SIMPLE.finditer(lowered)))
    text = lowered.decode(errors="replace")
    found = Counter(_ANY.findall(text) if len(data) < _LONG else (m[0] for m in _ANY.finditer(text)))
    return Counter({word.encode(): n for word, n in found.items()})


def damaged_words(doc_id: int | None, data: bytes) -> Iterator[tuple[bytes, int]]:
    """Words and counts of a text; of one run in EVERY a letter is dropped, by crc32 of ``doc_id:run``."""
    seed = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    seed = zlib.crc32(b":", seed)
    for run, n in _runs(data).items():
        h = zlib.crc32(run, seed)
        if h % EVERY == 0:
            letters = run.decode()
            at = h % len(letters)
            if len(letters) == LEAST_LETTERS:
                continue
            run = (letters[:at] + letters[at + 1 :]).encode()
        yield run, n


def _counted(batches: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[pa.RecordBatch]:
    def packed() -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts: dict[bytes, int] = {}
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for word, n in damaged_words(doc_id, text.as_py()):
                counts[word] = counts.get(word, 0) + n
            if len(counts) >= most:
                yield packed()
                counts = {}
    yield packed()


def damaged_counts(docs: DataFrame) -> DataFrame:
    """word, n of all documents, with seeded misspellings."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes("text").alias("data"))
    return rows.mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def letters_of(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of Latin-1 codes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def letter_counts(words: list[bytes]) -> np.ndarray:
    """How often each word has each letter: a-z, then the 64 from U+00C0 on."""
    out = np.zeros((len(words), 90), np.int32)
    codes = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    own = np.repeat(np.arange(len(words)), [len(w) for w in words])
    np.add.at(out, (own, np.where(codes < 0xC0, codes - 97, codes - 0xC0 + 26)), 1)
    return out


class KdTree:
    """Splits of letter counts; a leaf holds places in ``points``."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.leaves: list[np.ndarray] = []
        self.root = self._built(points, np.arange(len(points)), leaf)

    def _built(self, points: np.ndarray, own: np.ndarray, leaf: int) -> tuple:
        if len(own) > leaf:
            part = points[own]
            spread = part.var(axis=0)
            axis = int(spread.argmax())
            if spread[axis] > 0:
                column = part[:, axis]
                at = min(int(np.median(column)), int(column.max()) - 1)
                low = column <= at
                return axis, at, self._built(points, own[low], leaf), self._built(points, own[~low], leaf)
        self.leaves.append(own)
        return (len(self.leaves) - 1,)

    def reached(self, queries: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the queries whose box meets it: at most ``up`` counts one higher and ``down`` one lower."""
        count = len(queries)
        open_nodes = [(self.root, np.arange(count), np.full(count, up, np.int8), np.full(count, down, np.int8))]
        while open_nodes:
            node, own, ups, downs = open_nodes.pop()
            if not len(own):
                continue
            if len(node) == 1:
                yield node[0], own
                continue
            axis, at, low, high = node
            over = queries[own, axis] - at
            # Bounds of one axis only tighten, so a change of one is never charged twice.
            below = (over <= 0) | (over == 1) & (downs > 0)
            above = (over >= 1) | (over == 0) & (ups > 0)
            open_nodes.append((low, own[below], ups[below], downs[below] - (over[below] == 1)))
            open_nodes.append((high, own[above], ups[above] - (over[above] == 0), downs[above]))


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For words a and b of one length, letters by place first: which pairs differ in one letter."""
    differ = np.zeros((a.shape[1], b.shape[1]), np.uint16)
    for x, y in zip(a, b):
        differ += x[:, None] != y[None, :]
    return differ == 1


def one_longer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For words a, a letter longer than words b: which pairs are equal without one letter of a."""
    shape = a.shape[1], b.shape[1]
    equal, shared = np.ones(shape, bool), np.zeros(shape, np.uint16)
    for x, y in zip(a, b):  # from the front
        equal &= x[:, None] == y[None, :]
        shared += equal
    equal = np.ones(shape, bool)
    for x, y in zip(a[::-1], b[::-1]):  # from the end
        equal &= x[:, None] == y[None, :]
        shared += equal
    return shared >= len(b)


class Cell:
    """Words of one length and their counts, searched by k-d tree."""

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        self.words, self.counts = words, counts
        self.letters, self.points = np.ascontiguousarray(letters_of(words).T), letter_counts(words)
        self.tree = KdTree(self.points, LEAF)
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        self.by_rank = np.array(order, np.int64)

    def near(self, words: list[bytes], longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (visitor, member) that one edit parts."""
        points, letters, pairs = letter_counts(words), np.ascontiguousarray(letters_of(words).T), []
        check = one_longer if longer else one_replaced
        for leaf, own in self.tree.reached(points, 0 if longer else 1, 1):
            members = self.tree.leaves[leaf]
            some = max(1, (1 << 22) // len(members))
            for at in range(0, len(own), some):
                part = own[at : at + some]
                q, m = np.nonzero(check(letters[:, part], self.letters[:, members]))
                pairs.append((part[q], members[m]))
        if not pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*pairs))


def _best(own: np.ndarray, rank: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per place: how many pairs it is in, and the smallest rank among their other sides."""
    low = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(low, own, rank)
    return np.bincount(own, minlength=size), low


FOUND = "word string, n_near bigint, best_n bigint, best string"
MEMBER, EQUAL, LONGER = 0, 1, 2


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part and kind, members of a part before its visitors."""
    key, cell = None, None
    members: list[tuple[bytes, int]] = []
    totals: dict[int, list] = {}  # of members, from longer visitors: [neighbours, -n, word]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        words, near, best_n, best = zip(*out) if out else ([],) * 4
        text = lambda x: pa.array([w.decode("latin-1") for w in x], pa.string())
        return pa.RecordBatch.from_arrays([text(words), pa.array(near, pa.int64()), pa.array(best_n, pa.int64()), text(best)], names=["word", "n_near", "best_n", "best"])

    def visit(words: list[bytes], counts: list[int], longer: bool) -> list[tuple]:
        if cell is None or not words:
            return []
        q, m = cell.near(words, longer)
        near, low = _best(q, cell.rank[m], len(words))
        best = [int(cell.by_rank[low[i]]) if near[i] else 0 for i in range(len(words))]
        out = [(words[i], int(near[i]), cell.counts[best[i]], cell.words[best[i]]) for i in np.flatnonzero(near).tolist()]
        if longer:
            for i, j in zip(m.tolist(), q.tolist()):
                own = totals.setdefault(i, [0, 0, b""])
                own[1:] = min(own[1:], [-counts[j], words[j]])
                own[0] += 1
        return out

    def closed() -> list[tuple]:
        out = [(cell.words[i], n, -low, best) for i, (n, low, best) in totals.items()] if cell else []
        totals.clear()
        return out

    def planted() -> list[tuple]:
        """Members all there: their tree is built, and they look for one another."""
        nonlocal cell, members
        if not members:
            return []
        words, counts = map(list, zip(*members))
        cell, members = Cell(words, counts), []
        return visit(words, counts, False)

    for batch in batches:
        out, waiting, kind = [], [], None

        def flushed() -> None:
            if waiting:
                out.extend(visit(*map(list, zip(*waiting)), kind == LONGER))
                waiting.clear()

        for part, own_kind, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if part != key:
                flushed()
                out += planted() + closed()
                key, cell = part, None
            if own_kind == MEMBER:
                members.append((word.encode("latin-1"), n))
                continue
            if own_kind != kind or cell is None:
                flushed()
                out += planted()
                kind = own_kind
            waiting.append((word.encode("latin-1"), n))
        flushed()
        yield packed(out)
    yield packed(planted() + closed())


class Upper:
    """The upper levels of the trees: for each length, splits that deal its words to cells."""

    def __init__(self, sample: list[str], sizes: dict[int, int], cell_size: int) -> None:
        by_length: dict[int, list[bytes]] = {}
        for word in sorted(sample):
            by_length.setdefault(len(word), []).append(word.encode("latin-1"))
        self.trees: dict[int, KdTree] = {}
        for length, size in sizes.items():
            own = by_length.get(length, [])
            cells = max(1, -(-size // cell_size))
            tree = KdTree(letter_counts(own), max(1, len(own) // cells) if cells > 1 else len(own) + 1)
            tree.leaves = [np.empty(0, np.int64)] * len(tree.leaves)  # the splits are all that is sent
            self.trees[length] = tree


def _dealt(upper: Upper):
    """Cell, kind, word, n: each word in its own cell and, as a visitor, in all that its box meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            counts = batch.column(1).to_numpy()
            points = letter_counts(words)
            lengths = np.array([len(w) for w in words], np.int64)
            cells, kinds, rows = [], [], []
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                for target, kind in ((length, EQUAL), (length - 1, LONGER)):
                    if target not in upper.trees:
                        continue
                    tree = upper.trees[target]
                    if kind == EQUAL:
                        home = np.zeros(len(own), np.int64)
                        for leaf, part in tree.reached(points[own], 0, 0):
                            home[part] = leaf
                    for leaf, part in tree.reached(points[own], int(kind == EQUAL), 1):
                        rows.append(own[part])
                        cells.append(np.full(len(part), target << 32 | leaf, np.int64))
                        kinds.append(np.where(home[part] == leaf, MEMBER, EQUAL) if kind == EQUAL else np.full(len(part), LONGER))
            if rows:
                rows = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(cells)), pa.array(np.concatenate(kinds).astype(np.int32)), batch.column(0).take(pa.array(rows)), pa.array(counts[rows])],
                    names=["cell", "kind", "word", "n"],
                )

    return run


def neighbours(words: DataFrame, cell_size: int = CELL_SIZE, sample: int = SAMPLE) -> DataFrame:
    """words: word (distinct, of letters as above) and n.  Per word with any: n_near and the best neighbour."""
    prepare(words.sparkSession)
    sizes = {r[0]: r[1] for r in words.groupBy(F.length("word").alias("length")).count().collect()}
    total = sum(sizes.values())
    picked = words.filter(F.pmod(F.xxhash64("word"), F.lit(max(1, total // sample))) == 0).select("word").limit(2 * sample)
    upper = Upper([r.word for r in picked.collect()], sizes, cell_size)
    dealt = stage(words.select("word", "n").mapInArrow(_dealt(upper), "cell bigint, kind int, word string, n bigint"), "cells")
    cells = dealt.filter(F.col("kind") == MEMBER).groupBy("cell").agg(F.ceil(F.count("*") / F.lit(2 * cell_size)).cast("int").alias("parts"))
    met = dealt.join(cells, "cell").withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    met = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kind = F.when((F.col("kind") == MEMBER) & (F.col("part") != F.col("own")), EQUAL).otherwise(F.col("kind"))
    placed = met.select(F.concat_ws(":", "cell", "part").alias("part"), kind.alias("kind"), "word", "n")
    found = placed.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_neighbours, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("low"), "best")).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("first.low")).alias("best_n"), F.col("first.best").alias("best"))


def variants(words: DataFrame, ratio: int = RATIO, **limits: int) -> DataFrame:
    """word, n, n_near, form (neighbour of largest n, if that is ``ratio`` times the word's), form_n and root."""
    words = stage(words.select("word", "n"), "words")
    met = words.join(neighbours(words, **limits), "word", "left")
    formed = F.col("best_n") >= F.lit(ratio) * F.col("n")
    forms = stage(
        met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")),
        "forms",
    )
    # Counts grow by ``ratio`` along forms, so doubling the steps ends after a few rounds.
    steps = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return forms.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def misspelt(docs: DataFrame, **limits: int) -> DataFrame:
    """The variants among all words of the documents with LEAST_LETTERS letters and LEAST_COUNT places or more."""
    counts = damaged_counts(docs).filter((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LETTERS))
    return variants(counts, **limits)
