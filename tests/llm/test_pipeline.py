"""The pipeline against the brute-force twins of its stages."""

from __future__ import annotations

from collections import Counter, defaultdict

import messy
import numpy as np
import pytest
import test_decontaminate
import test_mixing
import test_near_copies
import test_quality

import corpus_pipeline
from clausetrail.llm import quality
from clausetrail.llm.common import read

SMALL = "/root/testdata/sf0.001"


def staged(spark, docs, tmp_path):
    """What each stage returns, each written and read again."""
    out = []
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out.append(docs)
    return out


def test_stages(spark, tmp_path):
    docs = read(spark, SMALL, "documents")
    results = staged(spark, docs, tmp_path)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    known = {r.doc_id: r.quality for r in read(spark, SMALL, "labels").collect()}
    stats = {i: quality.statistics(t.encode()) for i, t in text.items()}
    moments = {}
    for k in (0, 1):
        own = np.array([[1.0, *stats[i]] for i in text if known.get(i) == k and not test_quality.held_out(i)])
        moments[k] = own.T @ own
    scores = quality.Discriminant(moments).scores(np.array(list(stats.values())))
    kept = sorted(i for i, s in zip(stats, scores) if s >= 0.3)
    assert sorted(r.doc_id for r in results[0].collect()) == kept

    kept = sorted(test_near_copies.first_ids([(i, text[i]) for i in kept]))
    assert sorted(r.doc_id for r in results[1].collect()) == kept

    items = [(r.item_id, r.text) for r in read(spark, SMALL, "benchmark").collect()]
    found = test_decontaminate.brute([(i, text[i]) for i in kept], items)
    kept = sorted(r[0] for r in found if not r[5])
    assert sorted(r.doc_id for r in results[2].collect()) == kept

    size = {i: len(text[i].split()) for i in kept}
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i in kept:
        sizes[source[i]] += size[i]
    copies = Counter(r.doc_id for r in results[3].collect())
    assert set(copies) <= set(kept) and max(copies.values()) <= 2
    for i, n in copies.items():
        taken[source[i]] += n * size[i]
    for s, want in test_mixing.expected_targets(sizes).items():
        assert abs(taken[s] - want) <= 0.02 * want + 60

    rows = results[4].collect()
    assert Counter(r.doc_id for r in rows) == copies and {r.shard for r in rows} <= set(range(16))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(d.columns == docs.columns for d in results[:4])
    assert Counter(map(str, corpus_pipeline.run(spark, SMALL).collect())) == Counter(map(str, rows))


@pytest.mark.parametrize("frame", [messy.frame, messy.empty])
def test_messy(spark, tmp_path, frame):
    docs = frame(spark)
    results = staged(spark, docs, tmp_path)
    assert all(d.columns == docs.columns for d in results[:4])
    assert results[4].columns == [*docs.columns, "shard", "slot"]
    before = {r.doc_id for r in docs.collect()}
    assert all({r.doc_id for r in d.collect()} <= before for d in results)
