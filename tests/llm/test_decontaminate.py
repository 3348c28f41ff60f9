from __future__ import annotations

import hashlib
import re

import messy
import pytest

from clausetrail.llm import decontaminate as dc
from clausetrail.llm.common import read
from clausetrail.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def split(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add("" if item is None else str(item))
    lengths = sorted({len(w) for w in windows})
    out = []
    for doc_id, text in docs:
        w = split(text)
        hit, names = [False] * len(w), set()
        for size in lengths:
            for i in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[i : i + size]))) is not None:
                    names |= found
                    hit[i : i + size] = [True] * size
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), sum(hit), len(names), digest, sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=str)


def items():
    long = messy.words(7, 20_000).split(" ")
    return [
        (1, " ".join(long[100:140])),
        (2, "One TWO three"),
        (3, None),
        (4, " .. "),
        (5, messy.words(12, 13)),
        (5, messy.words(12, 13)),
        (None, messy.words(3, 14)),
        (7, " ".join(long[120:160]) + " unseen"),
    ]


def test_sample(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, SMALL, "documents").collect()]
    bench = [(r.item_id, r.text) for r in read(spark, SMALL, "benchmark").collect()]
    rows = QUERIES["op3_decontamination"](spark, SMALL).collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, bench)
    assert any(r.contaminated for r in rows)


@pytest.mark.parametrize("block_windows", [500_000, 40])
def test_messy(spark, block_windows):
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    docs = [r[:2] for r in messy.documents()]
    rows = dc.contamination(messy.frame(spark), bench, block_windows=block_windows).collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, items())


def test_removal(spark):
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    docs = messy.frame(spark)
    bad = [r[0] for r in brute([r[:2] for r in messy.documents()], items()) if r[5]]
    kept = dc.remove_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(str, bad + [r.doc_id for r in kept.collect()])) == sorted(str(r[0]) for r in messy.documents())
    clean = {r.doc_id: r for r in dc.remove_spans(docs, bench).collect()}
    assert clean[6].text == "" and clean[6].source == "é" and clean[1].text is None
    long = messy.words(7, 20_000).split(" ")
    assert clean[7].text.split() == long[:100] + long[160:]


def test_empty_tables(spark):
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    assert dc.contamination(messy.empty(spark), bench).count() == 0
    rows = dc.contamination(messy.frame(spark), bench.limit(0)).collect()
    assert len(rows) == len(messy.documents()) and not any(r.n_hit for r in rows)
