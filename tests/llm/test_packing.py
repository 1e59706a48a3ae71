import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF_SMALL
from evstat.llm import packing, queries
from llm.helpers import empty_docs, hard_docs, hard_rows

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def ids(whole, text):
    return [*whole.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("ab'stle1!.  \n\t\x1c\xa0é漢") + ["<|endoftext|>"]), max_size=40))
def test_pieces_equal_whole_texts(parts):
    tokens = packing.tokens_of(PATH)
    text = "".join(parts)
    assert np.frombuffer(tokens(text), "<u2").tolist() == ids(tokens.whole, text)[:-1]


def check(rows, got, whole):
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    expected = defaultdict(list)
    for doc_id, text in rows:
        expected[doc_id].append(ids(whole, text))
    assert set(by_doc) == set(expected)
    for d, lists in expected.items():
        # pieces of a document are a partition of its ids
        parts = sorted(by_doc[d], key=lambda r: (r.doc_tokens, r.start))
        assert sum(p.length for p in parts) == sum(map(len, lists))
        if len(lists) == 1:
            at = 0
            for p in parts:
                assert p.start == at and p.doc_tokens == len(lists[0])
                piece = lists[0][at:at + p.length]
                assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
                at += p.length
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 1024
    used = sum(r.length for r in got)
    assert len(seqs) == -(-used // 1024)          # padding in the last sequence only


def test_small_corpus(spark, whole):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = queries.op1_curve_packing(spark, SF_SMALL).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got, whole)


def test_hard_rows(spark, whole):
    got = packing.pack(hard_docs(spark).withColumnRenamed("lang", "row"), PATH).collect()
    check([(r[0], r[1]) for r in hard_rows()], got, whole)


def test_empty(spark):
    assert packing.pack(empty_docs(spark), PATH).count() == 0


def test_hilbert_curve_is_a_walk():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    key = packing.hilbert_keys(g, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = g[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
