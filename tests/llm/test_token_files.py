from __future__ import annotations

import zlib

import messy
import numpy as np
import public_tokenizers
import pyarrow.orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clausetrail.llm import token_files
from clausetrail.llm.common import read
from clausetrail.llm.queries import QUERIES, tokenizer_file

SMALL = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = token_files.ChunkEncoder(tokenizer_file(), known_chunks=500)


def plain(text: str) -> list[int]:
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def expected(docs: list[tuple]) -> list[tuple]:
    out, start = [], 0
    for doc_id, text in docs:
        ids = [*plain(text or ""), 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_sample_round_trip(spark):
    docs = sorted((r.doc_id, r.text) for r in read(spark, SMALL, "documents").collect())
    assert sorted(map(tuple, QUERIES["op2_token_files"](spark, SMALL).collect())) == expected(docs)


@settings(max_examples=400, deadline=None)
@given(
    st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'\rsx1.é  \x1c"), st.characters(exclude_categories=["Cs"])), max_size=40)
)
def test_chunks_give_the_ids_of_the_whole(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == plain(text)


@pytest.mark.parametrize(
    "text", ["a  b", "a \n b", " a", "a ", "a\n\nb c", "x<|endoftext|> y", "it's 'll  've", "", " ", "\n ", "a   b   ", "a\n b.\nc, d.", "x \ny.. z", "é. 1. a,", "a\n\n", "a\n\n\nb"]
)
def test_white_space(text):
    assert np.frombuffer(ENCODER.encode([text, "z " + text])[0], "<u4").tolist() == plain(text)


def test_messy_documents(spark, tmp_path):
    token_files.write_tokens(messy.frame(spark), str(tmp_path / "t"), tokenizer_file())
    rows = sorted(map(tuple, token_files.token_digests(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    ids = [r[0] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    texts = {}
    for doc in messy.documents():
        texts.setdefault(doc[0], []).append(doc[1])
    at = 0
    for doc_id, start, n, check in rows:
        assert start == at
        at += n
        wanted = [expected([(doc_id, t)])[0][2:] for t in texts[doc_id]]
        assert (n, check) in wanted
    assert len(rows) == len(messy.documents())


def test_empty_table(spark, tmp_path):
    token_files.write_tokens(messy.empty(spark), str(tmp_path / "t"), tokenizer_file())
    assert token_files.token_digests(spark, str(tmp_path / "t")).count() == 0


def test_files_hold_indexes_and_lookups_push_down(spark, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_tokens(read(spark, SMALL, "documents"), path, tokenizer_file(), stripe_bytes=1 << 16)
    found = token_files.read_documents(spark, path, [5, 17])
    assert {r.doc_id: list(r.ids) for r in found.collect()} == {
        r.doc_id: [*plain(r.text or ""), 0] for r in read(spark, SMALL, "documents").filter("doc_id in (5, 17)").collect()
    }
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    file = next((tmp_path / "t").glob("*.orc"))
    assert pyarrow.orc.ORCFile(file).nstripes >= 1
    assert pyarrow.orc.ORCFile(file).row_index_stride == 1000
    sharper = str(tmp_path / "sharper")
    token_files.write_tokens(
        read(spark, SMALL, "documents"), sharper, tokenizer_file(), stripe_bytes=1 << 16, bloom_false_positives=1e-9
    )
    size = lambda d: sum(f.stat().st_size for f in (tmp_path / d).glob("*.orc"))
    assert size("sharper") > size("t")  # the filters are in the files
