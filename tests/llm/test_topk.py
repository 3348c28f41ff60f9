from __future__ import annotations

import math

import numpy as np
import pytest

from clausetrail.llm import topk
from clausetrail.llm.common import read
from clausetrail.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def brute(rows, every=50, k=5):
    whole = []
    for vec_id, vector in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            whole.append((vec_id, [math.floor(256 * float(x)) for x in vector]))
    out = []
    for q, a in whole:
        if q is None or q % every:
            continue
        scores = [(sum(x * y for x, y in zip(a, b)), v) for v, b in whole if v != q and len(a) == len(b)]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(q, i + 1, v, s) for i, (s, v) in enumerate(scores[:k])]
    return sorted(out, key=str)


def test_sample(spark):
    rows = [(r.vec_id, r.embedding) for r in read(spark, SMALL, "embeddings").collect()]
    got = QUERIES["op4_top_products"](spark, SMALL)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize(("block_rows", "query_rows", "seed_rows"), [(4096, 1024, 4096), (16, 3, 8), (7, 50, 1)])
def test_messy(spark, block_rows, query_rows, seed_rows):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 5])).tolist()) for i in range(150)]
    rows += [(200 + i, [1.0, -1.0, 0.5, 0.0, 0.0, 2.0]) for i in range(40)]
    rows += [(300, None), (350, []), (351, []), (400, [1.0]), (450, [float("nan")] * 6), (451, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(500, [0.0] * 6), (550, [float("inf")] + [0.0] * 5), (None, [3.0, -1.0, 0.5, 0.0, 0.0, 2.0]), (600, [-1.0] * 6)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, block string, rank int")
    got = topk.top_k(frame, "vec_id % 50 = 0", block_rows=block_rows, query_rows=query_rows, seed_rows=seed_rows, sample=40)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(frame, "vec_id % 50 = 0").count() == 0


def test_large_components_are_exact():
    a = np.array([[2**40 + 1, 3]], np.int64)
    b = np.array([[2**40 - 1, 5], [1, 1]], np.int64)
    found = topk.search_block(a, np.array([1]), np.array([-np.inf]), b, np.array([2, 3]), None, 5)
    assert found == [[((2**40 + 1) * (2**40 - 1) + 15, 2), (2**40 + 4, 3)]]
