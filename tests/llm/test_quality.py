from __future__ import annotations

import zlib

import messy
import numpy as np

from clausetrail.llm import quality
from clausetrail.llm.common import read
from clausetrail.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    rows = QUERIES["op5_quality"](spark, MIDDLE).collect()
    docs = {r.doc_id: r.text for r in read(spark, MIDDLE, "documents").collect()}
    labels = {r.doc_id: r.quality for r in read(spark, MIDDLE, "labels").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in tested) / len(tested) > 0.97
    good = [r.score for r in tested if labels[r.doc_id]]
    bad = [r.score for r in tested if not labels[r.doc_id]]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.99


def test_fit_equals_a_plain_one(spark):
    docs, labels = read(spark, MIDDLE, "documents"), read(spark, MIDDLE, "labels")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.doc_id, quality.statistics((r.text or "").encode())) for r in docs.collect()]
    moments = {}
    for k in (0, 1):
        own = np.array([[1.0, *x] for i, x in rows if known.get(i) == k and not held_out(i)])
        moments[k] = own.T @ own
    want = dict(zip((i for i, _ in rows), quality.Discriminant(moments).scores(np.array([x for _, x in rows]))))
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_messy(spark):
    labels = read(spark, MIDDLE, "labels")
    odd = spark.createDataFrame([(None, 1, 0), (1, None, None), (3, 7, 0), (3, 0, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    for marks in (labels, odd, labels.limit(0)):
        rows = quality.score_documents(messy.frame(spark), marks).collect()
        assert len(rows) == len(messy.documents())
        assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0.5 for r in rows)
    assert quality.keep_good(messy.frame(spark), labels).columns == messy.frame(spark).columns
    assert quality.score_documents(messy.empty(spark), labels).count() == 0
