from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import messy
import numpy as np

from clausetrail.llm import sharding
from clausetrail.llm.common import read
from clausetrail.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    return all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sample(spark):
    docs = {r.doc_id: r.text for r in read(spark, SMALL, "documents").collect()}
    rows = QUERIES["op7_shards"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    assert gapless(rows)
    assert sorted(rows) == sorted(QUERIES["op7_shards"](spark, SMALL).collect())
    by_shard = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert by_shard != sorted(by_shard)


def test_grown_shards_take_rows_only_into_the_new_one(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    rows = ids.select("doc_id", sharding.shard_of(ids.doc_id, 16).alias("a"), sharding.shard_of(ids.doc_id, 17).alias("b")).collect()
    assert all(r.b in (r.a, 16) for r in rows)
    counts = Counter(r.a for r in rows)
    assert len(counts) == 16 and max(counts.values()) < 340 and min(counts.values()) > 170
    assert 150 < sum(r.b == 16 for r in rows) < 330


def test_messy_with_many_buckets(spark, tmp_path):
    docs, path = messy.frame(spark), str(tmp_path / "s")
    sharding.write_shards(docs, path, shards=3, bucket_bytes=2000)
    written = sharding.read_shards(spark, path, docs.schema)
    rows = sharding.placements(written, 3).collect()
    assert gapless(rows)
    back = written.select("doc.*")
    assert back.columns == docs.columns
    assert Counter(map(str, back.collect())) == Counter(map(str, docs.collect()))


def test_empty(spark, tmp_path):
    sharding.write_shards(messy.empty(spark), str(tmp_path / "s"))
    assert sharding.read_shards(spark, str(tmp_path / "s"), messy.empty(spark).schema).count() == 0
    assert sharding.shard_documents(messy.empty(spark)).count() == 0


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(3)
    counts = Counter(tuple(sharding.fisher_yates(3, rng)) for _ in range(6000))
    assert len(counts) == 6 and all(850 < c < 1150 for c in counts.values())
    assert sharding.fisher_yates(0, rng).tolist() == [] and sharding.fisher_yates(1, rng).tolist() == [0]
