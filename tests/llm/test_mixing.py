from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import messy
import numpy as np
import pytest

from clausetrail.llm import mixing
from clausetrail.llm.common import read
from clausetrail.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def expected_targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(rows, docs):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += count(d["text"])
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d["doc_id"], count(d["text"])) for d in docs)
    target = expected_targets(sizes)
    by_id = defaultdict(set)
    for d in docs:
        by_id[d["doc_id"], count(d["text"])].add(d["source"])
    taken = defaultdict(int)
    for r in rows:
        source = next(iter(by_id[r.doc_id, r.size]))
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
        assert r.size == 0 and r.taken == 0 or r.taken % r.size == 0 and r.taken <= 2 * r.size
        taken[source] += r.taken
    return taken, target


def test_mix_of_the_sample(spark):
    docs = [r.asDict() for r in read(spark, SMALL, "documents").collect()]
    rows = QUERIES["op1_source_mix"](spark, SMALL).collect()
    taken, target = check(rows, docs)
    for source, words in target.items():
        assert abs(taken[source] - words) <= 0.02 * words + 60
    assert sorted(rows) == sorted(QUERIES["op1_source_mix"](spark, SMALL).collect())


def test_messy_documents(spark):
    chosen = mixing.choose(mixing.sized_documents(messy.frame(spark)))
    rows = chosen.selectExpr("doc_id", "size", "source_size", "target", "size * copies as taken").collect()
    docs = [dict(zip(("doc_id", "text", "lang", "source"), r)) for r in messy.documents()]
    assert len(rows) == len(docs)
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    want = expected_targets(sizes)
    assert {round(r.target, 6) for r in rows} == {round(x, 6) for x in want.values()}
    mixed = mixing.mix(messy.frame(spark))
    assert mixed.columns == messy.frame(spark).columns
    per_id = Counter()
    for r in rows:
        per_id[r.doc_id] += r.taken // r.size if r.size else 0
    assert Counter(r.doc_id for r in mixed.collect()) == +per_id
    assert mixing.mix(messy.empty(spark)).count() == 0


def test_one_length_for_all(spark):
    rows = [(i, "a b c", "s" if i % 3 else "t") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    chosen = mixing.choose(mixing.sized_documents(docs)).collect()
    taken = Counter()
    for r in chosen:
        taken[r.source] += r.size * r.copies
    want = expected_targets({"s": 1800, "t": 900})
    assert all(abs(taken[s] - want[s]) <= 3 for s in want)


def test_knapsack_is_best():
    pick = random.Random(5)
    for _ in range(200):
        sizes = pick.sample(range(1, 30), pick.randint(1, 4))
        counts = [pick.randint(0, 4) for _ in sizes]
        budget = pick.randint(0, 120)
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        taken = mixing.knapsack(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert sum(s * t for s, t in zip(sizes, taken)) == max(x for x in sums if x <= budget)


def test_budgets_are_met():
    rng = np.random.default_rng(1)
    sizes = np.unique(rng.integers(1, 5000, 400))
    counts = rng.integers(1, 50, len(sizes))
    total = int((sizes * counts).sum())
    for share in (0.01, 0.3, 0.77, 1):
        taken = mixing.fit_counts(sizes, counts, int(total * share), dp_words=3000)
        assert (taken <= counts).all() and int((sizes * taken).sum()) == int(total * share)
