import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF_ORACLE
from evstat.llm import bpe, queries
from tests.llm.helpers import empty_docs, hard_docs, hard_rows

PATH = queries.tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


PIECES = ["don't", "'S 'LL", " \x1c\x85　\n", "<|endoftext|>", "<|startoftext|>", "<|endoftext|", "é", "ΣΑΣ", "İıſK", "½Ⅷ٣", "漢字", "\U00018e12·",
          "aaaaaaa", "ababab", "ﬁ", "ﬀ", "!!!", "\x00", "\U0001f44d\U0001f3fd", "straße", "0123", "Ｏ", "۞", "ௗெ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=12)), max_size=10).map("".join))
def test_ids_and_text_are_the_library_s(library, text):
    text = text.encode("utf-8", "ignore").decode()
    e = bpe.encoder(PATH)
    want = library.encode(text, add_special_tokens=False).ids
    assert e.encode(text).tolist() == want
    assert e.decode(pa.array([want], pa.list_(pa.int32())))[0].as_py() == library.decode(want, skip_special_tokens=False)


def plain_merge(e, symbols):
    """One pass over all pairs for every merge."""
    symbols = list(symbols)
    while True:
        best = min(((r, i) for i in range(len(symbols) - 1)
                    if (r := e.rank.get(symbols[i] << e.shift | symbols[i + 1])) is not None), default=None)
        if best is None:
            return symbols
        symbols[best[1]:best[1] + 2] = [e.merged[best[0]]]


def test_tree_merges_leftmost_lowest_rank():
    e = bpe.encoder(PATH)
    rng = random.Random(4)
    for _ in range(300):
        data = "".join(rng.choices("aeinst", k=rng.randint(1, 60))).encode()
        symbols = [e.inner[b] for b in data[:-1]] + [e.last[data[-1]]]
        assert e.merge(list(symbols)) == plain_merge(e, symbols)


def test_segment_tree():
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 64, 100):
        leaves = [rng.randrange(50) for _ in range(n)]
        tree = bpe.SegmentTree(list(leaves), 99)
        for _ in range(200):
            assert tree.nodes[1] == min(leaves)
            i, v = rng.randrange(n), rng.choice([rng.randrange(50), 99])
            leaves[i] = v
            tree.update(i, v)


def test_long_pieces(library):
    for text in ("a" * 20_000, "ab" * 9_000, "the" * 5_000 + "é" * 3_000):
        assert bpe.encoder(PATH).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_on_given_documents(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").collect()}
    rows = queries.op13_segment_tree_bpe(spark, SF_ORACLE).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_hard_rows(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 7)
    docs = hard_docs(spark).selectExpr("*", "text as ids", "1 as decoded", "1 as _text")
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted(out.columns) == sorted([*docs.columns])
    rows = out.collect()
    want = [(t, library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in hard_rows()]
    assert sorted(map(repr, ((r.text, r.ids, r.decoded) for r in rows))) == sorted(
        repr((t, ids, library.decode(ids, skip_special_tokens=False))) for t, ids in want)
    assert bpe.decode(bpe.encode(empty_docs(spark), PATH), PATH).count() == 0


def test_decode_of_odd_ids(spark, library):
    df = spark.createDataFrame([(1, [320, None, 999_999, -4, 49407, 320]), (2, None), (3, [])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert got == {1: library.decode([320, 49407, 320], skip_special_tokens=False), 2: "", 3: ""}


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(queries.tokenizer_path())
