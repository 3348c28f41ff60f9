from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import messy
import pytest

from clausetrail.llm import spelling
from clausetrail.llm.common import read
from clausetrail.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def counted(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts):
    own = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and x != w and near(w, x)] for w in counts}
    form = {}
    for w, x in own.items():
        best = min(x, key=lambda y: (-counts[y], y), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, counts[w], len(own[w]), form[w], counts.get(form[w]), root))
    return out


def found(frame):
    rows = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def tangled():
    """Words of few letters, many with equal counts, with chains of forms."""
    pick = random.Random(8)
    counts = {}
    for _ in range(700):
        word = "".join(pick.choice("aeà÷") for _ in range(pick.randint(6, 9)))
        counts[word] = pick.choice([5, 6, 30, 31, 200, 1200])
    for k in range(60):  # all with equal letter counts
        counts["".join(pick.sample("abcdef", 6))] = 5 + k
    return counts


@pytest.mark.parametrize("limits", [{}, {"cell_size": 20}, {"cell_size": 3, "sample": 40}])
def test_brute_force(spark, limits):
    counts = tangled()
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(4)
    assert found(spelling.variants(words, **limits)) == expected(counts)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, SMALL, "documents").collect()]
    counts = counted(docs)
    assert found(QUERIES["op13_spelling_variants"](spark, SMALL)) == expected(counts)
    assert len(counts) > 300


def test_messy(spark):
    counts = counted([d[:2] for d in messy.documents()])
    assert found(spelling.misspelt(messy.frame(spark))) == expected(counts)
    assert spelling.misspelt(messy.empty(spark)).count() == 0


def test_counts_of_texts():
    texts = ["Straße Ãpfel×und÷ ÀÉ", "aaaaaaA bbbbbbb'ccccccc", "ſchön İstanbul ñandú Ñandú", "x" * 30_000, "é" * 9 + " Ÿabcdefg"]
    docs = [(i, (t + " ") * 5) for i in range(400, 460) for t in texts]
    got = Counter()
    for i, t in docs:
        for w, n in spelling.damaged_words(i, t.encode()):
            got[w.decode()] += n
    assert {w: n for w, n in got.items() if n >= 5} == counted(docs)
