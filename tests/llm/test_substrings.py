from __future__ import annotations

import random
from collections import Counter

import messy

from clausetrail.llm import substrings
from clausetrail.llm.common import read
from clausetrail.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def split(text):
    data, at, out = (text or "").encode(), 0, []
    for end in substrings.cuts(data):
        out.append(data[at:end])
        at = end
    assert b"".join(out) == data
    return out


def spans_of(docs, least=substrings.LEAST_BYTES):
    """For each document, the runs of chunks that a document with a smaller id has too."""
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, t in docs:
        for c in split(t):
            first[c] = min(first.get(c, rank(i)), rank(i))
    for i, t in docs:
        out, at = [], 0
        for c in split(t):
            if first[c] < rank(i):
                if out and out[-1][1] == at:
                    out[-1][1] = at + len(c)
                else:
                    out.append([at, at + len(c)])
            at += len(c)
        yield i, t, [s for s in out if s[1] - s[0] >= least]


def check(rows, docs):
    want = Counter(
        (i, len((t or "").encode()), len(s), sum(b - a for a, b in s), ",".join(f"{a}:{b}" for a, b in s)) for i, t, s in spans_of(docs)
    )
    assert Counter((r.doc_id, r.n_bytes, r.n_passages, r.removable_bytes, r.spans) for r in rows) == want


def test_sample_and_messy(spark):
    check(QUERIES["op9_repeated_passages"](spark, SMALL).collect(), [(r.doc_id, r.text) for r in read(spark, SMALL, "documents").collect()])
    check(substrings.repeats(messy.frame(spark)).collect(), [d[:2] for d in messy.documents()])
    assert substrings.repeats(messy.empty(spark)).count() == 0


def test_texts_without_their_repeats(spark):
    docs = messy.frame(spark)
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns
    want = Counter()
    for i, t, spans in spans_of([d[:2] for d in messy.documents()]):
        data, at, kept = (t or "").encode(), 0, b""
        for a, b in spans:
            kept, at = kept + data[at:a], b
        want[i, (kept + data[at:]).decode(errors="replace")] += 1
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == want
    assert substrings.remove_repeats(messy.empty(spark)).count() == 0


def test_planted_passages_are_found_and_other_texts_left(spark):
    """Passages of 51 to 90 words in otherwise new texts; the smallest id keeps its copy."""
    pick = random.Random(2)
    passages = [messy.words(7000 + k, pick.randint(51, 90)) for k in range(12)]
    docs, holds = [], {}
    for i in range(240):
        own = messy.words(8000 + i, 150).split()
        if i % 2:
            at, k = pick.randrange(150), pick.randrange(12)
            own[at:at] = passages[k].split()
            holds.setdefault(k, []).append(i)
        docs.append((i, " ".join(own)))
    rows = {r.doc_id: r for r in substrings.repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    later = {i for ids in holds.values() for i in ids[1:]}
    assert sum(rows[i].removable_bytes > 0 for i in later) >= 0.95 * len(later)
    clean = set(rows) - later
    assert sum(rows[i].removable_bytes == 0 for i in clean) >= 0.95 * len(clean)


def test_an_insertion_changes_few_chunks():
    text = messy.words(4, 400)
    before, after = Counter(split(text)), Counter(split(text[:700] + " inserted " + text[700:]))
    assert sum((before - after).values()) <= 8


def test_chunk_rows_are_narrow_and_long_texts_keep_their_places(spark):
    text = messy.words(4, 400) + "z" * 1000
    docs = spark.createDataFrame([(0, 1, text), (1, 2, "")], "row bigint, id bigint, text string")
    rows = substrings.chunk_rows(docs)
    assert set(rows.dtypes) == {(c, "bigint") for c in ("row", "id", "at", "high", "low")}
    ends = [r.at // substrings.SPAN + r.at % substrings.SPAN for r in rows.orderBy("at").collect()]
    assert ends == substrings.cuts(text.encode()) and substrings.MAX_BYTES < substrings.SPAN
