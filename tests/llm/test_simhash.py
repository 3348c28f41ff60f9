from __future__ import annotations

import random
import re
from collections import Counter

import messy
import pytest
import xxhash

from clausetrail.llm import simhash
from clausetrail.llm.common import read
from clausetrail.llm.components import components
from clausetrail.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def fingerprint(text) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values: list[int], radius: int = 4) -> dict[int, int]:
    """Smallest position each is connected with."""
    name = list(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius and name[i] != name[j]:
                low, high = sorted((name[i], name[j]))
                name = [low if x == high else x for x in name]
    return dict(enumerate(name))


def expected(docs):
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    prints = [fingerprint(t) for _, t in docs]
    names = groups(prints)
    return Counter((d[0], f"{p:016x}", docs[names[i]][0]) for i, (d, p) in enumerate(zip(docs, prints)))


def test_sample(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, SMALL, "documents").collect()]
    assert Counter(map(tuple, QUERIES["op10_near_copies"](spark, SMALL).collect())) == expected(docs)


def test_messy(spark):
    found = simhash.documents_with_groups(messy.frame(spark)).collect()
    got = Counter((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in found)
    assert got == expected([r[:2] for r in messy.documents()])
    kept = simhash.drop_near_copies(messy.frame(spark))
    assert kept.columns == messy.frame(spark).columns
    firsts = {n for _, _, n in expected([r[:2] for r in messy.documents()])}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(firsts)
    assert simhash.drop_near_copies(messy.empty(spark)).count() == 0


@pytest.mark.parametrize(("tree_size", "blocks"), [(4096, None), (7, None), (40, 6), (5, 8)])
def test_links_are_complete(spark, tree_size, blocks):
    pick = random.Random(9)
    values = {0, 1, 2**64 - 1}
    for _ in range(30):
        seed = pick.getrandbits(64)
        values.add(seed)
        for _ in range(12):
            value = seed
            for bit in pick.sample(range(64), pick.randint(1, 6)):
                value ^= 1 << bit
            values.add(value)
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    links = simhash.fingerprint_links(frame, 4, tree_size, blocks).collect()
    at = {v: i for i, v in enumerate(signed)}
    name = list(range(len(values)))
    for link in links:
        low, high = sorted((name[at[link.u]], name[at[link.v]]))
        name = [low if x == high else x for x in name]
    assert dict(enumerate(name)) == groups(values)


def test_tree_search_is_exact():
    pick = random.Random(4)
    values = {pick.getrandbits(12) for _ in range(300)}
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 37):
        assert sorted(tree.near(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_long_chain_of_links(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(500, 501)], "u bigint, v bigint")
    rows = {r.node: r.root for r in components(links).collect()}
    assert rows == {**dict.fromkeys(range(200), 0), 500: 500, 501: 500}
    assert components(links.limit(0)).count() == 0
