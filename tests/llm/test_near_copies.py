from __future__ import annotations

import random
import re
from collections import Counter

import messy
import pytest
import test_simhash
from pyspark.sql import functions as F

import corpus_pipeline
from clausetrail.llm import near_copies
from clausetrail.llm.common import read

SMALL = "/root/testdata/sf0.001"


def shingles(text) -> frozenset:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def first_ids(docs):
    """The smallest id of every group that brute-force Jaccard links."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    sets = [shingles(t) for _, t in docs]
    name = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if name[i] != name[j] and 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                low, high = sorted((name[i], name[j]))
                name = [low if x == high else x for x in name]
    return Counter(docs[i][0] for i in set(name))


def edited(seed: int, words: list[str], changes: int) -> str:
    pick, words = random.Random(seed), list(words)
    for at in pick.sample(range(len(words)), changes):
        words[at] = f"new{seed}x{at}"
    return " ".join(words)


def variants():
    """Groups of texts with one to four changed words of 100: similarities from 0.5 to 0.95."""
    rows = []
    for g in range(12):
        base = messy.words(1000 + g, 100).split()
        rows += [(100 * g + i, edited(100 * g + i, base, 1 + i % 4)) for i in range(8)]
    base = messy.words(2000, 120).split()
    return rows + [(5000 + i, edited(5000 + i, base, 1 + i % 5)) for i in range(60)]


def ids(frame):
    return Counter(r.doc_id for r in frame.select("doc_id").collect())


@pytest.mark.parametrize("limits", [{}, {"small": 3, "rounds": 0}, {"small": 3, "rounds": 2, "sample": 40}])
def test_all_pairs_of_brute_force_are_linked(spark, limits):
    frame = spark.createDataFrame(variants(), "doc_id bigint, text string").repartition(5)
    want = first_ids(variants())
    assert ids(near_copies.drop_near_copies(frame, **limits)) == want


def test_the_stage_links_what_fingerprints_miss(spark):
    docs = variants()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    fingerprints = {n for _, _, n in test_simhash.expected(docs)}
    assert ids(corpus_pipeline.near_copies(spark, frame, SMALL)) == first_ids(docs)
    assert len(first_ids(docs)) < len(fingerprints)


def test_sample_and_messy(spark):
    docs = read(spark, SMALL, "documents")
    assert ids(near_copies.drop_near_copies(docs)) == first_ids([(r.doc_id, r.text) for r in docs.collect()])
    kept = near_copies.drop_near_copies(messy.frame(spark))
    assert kept.columns == messy.frame(spark).columns
    assert ids(kept) == first_ids([d[:2] for d in messy.documents()])
    assert near_copies.drop_near_copies(messy.empty(spark)).count() == 0


def test_levels_tell_in_how_many_sets_a_shingle_stands(spark):
    docs = [(i, t) for i, t in enumerate(["", *(t for _, t in variants()[:30])])]
    frame = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in docs], "node bigint, data binary").repartition(4)
    sets = [near_copies.shingles(t.encode()) for _, t in docs]
    counts = Counter(h for s in sets for h in s.tolist())
    want = {i: [(counts[h] - 1).bit_length() for h in sets[i].tolist()] for i, _ in docs}
    for per_task in (2, 1000):
        found = {r.node: list(r.levels) for r in near_copies.shingle_levels(frame, 5, per_task).collect()}
        assert {n: found.get(n, []) for n in want} == want


def test_shingles_of_one_text_are_not_sent(spark):
    """Versions that differ too much begin with shingles of their own: few rows meet, however many versions there are."""
    base = messy.words(3000, 100).split()
    docs = [(i, bytearray(edited(i, base, 12).encode())) for i in range(40)]
    frame = spark.createDataFrame(docs, "node bigint, data binary")
    rooted = frame.join(near_copies.shingle_levels(frame, 5, 100), "node").selectExpr("node", "node AS root", "data", "levels")
    sent = rooted.mapInArrow(near_copies._prefixes(5, near_copies.Fraction("0.8")), near_copies.KEYED + ", hot boolean")
    assert sent.count() == 0


def test_joins_leave_the_texts_where_they_are(spark, monkeypatch):
    plans, similar_nodes = [], near_copies.similar_nodes

    def spy(texts, *args):
        plans.append(texts.join(texts.select("node"), "node")._jdf.queryExecution().executedPlan().toString())
        return similar_nodes(texts, *args)

    monkeypatch.setattr(near_copies, "similar_nodes", spy)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near_copies.drop_near_copies(spark.createDataFrame(variants(), "doc_id bigint, text string")).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    scans = [line for line in plans[0].splitlines() if "_extract_text" in line or "FileScan" in line and "doc#" in line]
    assert any("Bucketed: true" in line for line in scans) and not any("Bucketed: false" in line for line in scans)


def test_pairs_that_differ_too_much_are_not_compared(spark, monkeypatch):
    """One large group whose versions are mostly too different: few pairs are compared, and no link is lost."""
    base = messy.words(4000, 150).split()
    docs = [(i, edited(i, base, 1 + i % 6)) for i in range(160)]
    compared, verified = [], near_copies._verified

    def spy(pairs, *args, **kwargs):
        compared.append(pairs.distinct().count())
        return verified(pairs, *args, **kwargs)

    monkeypatch.setattr(near_copies, "_verified", spy)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert ids(near_copies.drop_near_copies(frame, rounds=0)) == first_ids(docs)
    sets = [shingles(t) for _, t in docs]
    similar = sum(10 * len(a & b) >= 8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert sum(compared) <= 2 * similar, (compared, similar)


def test_signatures_drop_no_similar_pair(spark):
    docs = [(i, bytearray((t or "").encode())) for i, t in [*variants(), (9000, ""), (9001, "one"), (9002, "one two"), (9003, messy.words(5, 3000))]]
    found = spark.createDataFrame(docs, "node bigint, data binary").mapInArrow(
        near_copies._signatures(5), ", ".join(["node bigint", *(f"{x} bigint" for x in near_copies.PARITIES)])
    )
    sets = {i: near_copies.shingles(bytes(t)) for i, t in docs}
    sizes = spark.createDataFrame([(i, len(x)) for i, x in sets.items()], "node bigint, n int")
    signed = found.join(sizes, "node").select("node", "n", F.struct(*near_copies.PARITIES).alias("signature"))
    other = signed.toDF("other_node", "other_n", "other_signature")
    near = near_copies._not_too_different(near_copies.Fraction("0.8"), F.col("n"), "signature", F.col("other_n"), "other_signature")
    kept = {(r.node, r.other_node) for r in signed.crossJoin(other).filter("node < other_node").filter(near).select("node", "other_node").collect()}
    similar = {(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and near_copies.similar(a, b, near_copies.Fraction("0.8"))}
    assert similar <= kept and len(kept) < len(sets) * (len(sets) - 1) / 4
