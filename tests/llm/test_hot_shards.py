from __future__ import annotations

from collections import Counter

import pytest

from clausetrail.llm import sharding


@pytest.mark.parametrize("doc_id", [7, None])
@pytest.mark.parametrize("same_text", [False, True])
def test_a_hot_id_spreads_over_many_buckets(spark, monkeypatch, tmp_path, doc_id, same_text):
    """Rows of one id, different or identical, with others; 16 000 bytes of them in buckets of 1 000."""
    text = lambda i: f"text {0 if same_text else i:04d} {'x' * 29}"
    rows = [(doc_id, text(i)) for i in range(400)] + [(100 + i, text(i)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    sizes = str(tmp_path / "sizes")

    def permute(seed):
        plain = original(seed)

        def run(bucket):
            import os
            import uuid

            os.makedirs(sizes, exist_ok=True)
            with open(f"{sizes}/{uuid.uuid4().hex}", "w") as file:
                file.write(str(bucket.num_rows))
            return plain(bucket)

        return run

    original = sharding._permute
    monkeypatch.setattr(sharding, "_permute", permute)
    out = sharding.shard_documents(docs, shards=2, bucket_bytes=1000).collect()
    counts = [int(f.read_text()) for f in (tmp_path / "sizes").iterdir()]
    assert max(counts) < 80 and len(counts) > 20
    assert Counter((r.doc.doc_id, r.doc.text) for r in out) == Counter(rows)
    for shard in (0, 1):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in out if r.doc.doc_id == doc_id}) == 1
