from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import messy
import pytest

from clausetrail.llm import suffix_repeats
from clausetrail.llm.common import read
from clausetrail.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TINY = [{}, {"block_bytes": 3000, "entries": 500, "crowd": 3}]


def removed(docs):
    """Per document, whether each byte is in a 50-byte string that starts in a document with a smaller id."""
    low = {}
    rank = lambda i: (i is None, i or 0)
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            low[w] = min(low.get(w, rank(i)), rank(i))
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if low[b[p : p + 50]] < rank(i):
                gone[p : p + 50] = b"\1" * 50
        yield i, b, gone


def expected(docs):
    out = Counter()
    for i, b, gone in removed(docs):
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out[i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()] += 1
    return out


def found(rows):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows.collect())


def tangled():
    """Texts of shared pieces: nested repeats, periods, repeats of 49 to 51 bytes, marks before and after."""
    pick = random.Random(4)
    parts = [messy.words(900 + i, 12)[: pick.choice([49, 50, 51, 70])] for i in range(12)] + ["ab" * 60, "\0" * 120, "é" * 70]
    rows = []
    for i in range(80):
        text = "".join(pick.choice(parts) + pick.choice(["", "x", "\0", messy.words(5000 + i, 3)]) for _ in range(pick.randint(0, 8)))
        rows.append((pick.choice([i, i, 7, None]), text))
    return rows


@pytest.mark.parametrize("limits", TINY)
def test_brute_force(spark, limits):
    docs = tangled()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert found(suffix_repeats.removals(frame, **limits)) == expected(docs)
    assert found(suffix_repeats.removals(messy.frame(spark), **limits)) == expected([d[:2] for d in messy.documents()])
    assert suffix_repeats.removals(messy.empty(spark), **limits).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, SMALL, "documents").collect()]
    assert found(QUERIES["op11_maximal_repeats"](spark, SMALL)) == expected(docs)


@pytest.mark.parametrize("limits", TINY)
def test_groups_hold_every_repeat(spark, limits):
    """Each group is one string at all its places, and every 50-byte string that occurs again is in a group with all its places."""
    docs = tangled()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    data = [(t or "").encode() for _, t in docs]
    groups = defaultdict(set)
    for r in suffix_repeats.maximal_repeats(frame, **limits).collect():
        assert docs[r.row][0] == r.doc_id
        groups[r.group, r.length].add((r.row, r.start))
    places, covered = defaultdict(set), defaultdict(set)
    for n, b in enumerate(data):
        for p in range(len(b) - 49):
            places[b[p : p + 50]].add((n, p))
    for (_, length), own in groups.items():
        strings = {data[n][p : p + length] for n, p in own}
        assert len(strings) == 1 and len(own) > 1
        string = strings.pop()
        assert len(string) == length >= 50
        for k in range(length - 49):
            covered[string[k : k + 50]] |= {(n, p + k) for n, p in own}
    assert {w: x for w, x in places.items() if len(x) > 1} == dict(covered)


def test_intervals_are_maximal():
    pieces = [b"Q" + b"m" * 30 + b"n" * 30 + x for x in (b"1", b"2")] + [b"R" + b"m" * 30 + b"n" * 30 + b"3"]
    array = suffix_repeats.SuffixArray(pieces)
    got = {(length, frozenset(zip(array.piece[a : b + 1].tolist(), array.offset[a : b + 1].tolist()))) for length, a, b in array.intervals()}
    assert got == {(61, frozenset({(0, 0), (1, 0)})), (60, frozenset({(0, 1), (1, 1), (2, 1)}))}


def test_texts_without_repeats(spark):
    docs = messy.frame(spark)
    out = suffix_repeats.remove_repeats(docs, block_bytes=3000, entries=500)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = Counter()
    for i, b, gone in removed([d[:2] for d in messy.documents()]):
        want[i, bytes(c for c, g in zip(b, gone) if not g).decode(errors="replace")] += 1
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == want


def test_texts_are_not_shuffled_after_the_table(spark):
    texts = suffix_repeats.Texts(read(spark, SMALL, "documents").select("doc_id", "text"), block_bytes=50_000)
    plan = suffix_repeats._results(texts, True)._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("FlatMapCoGroups") :]
    scan = side.index("Bucketed: true")
    assert "Exchange" not in side[:scan]
