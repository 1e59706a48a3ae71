from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as P
from conftest import SF_SMALL
from evstat.llm import mixing, queries, secret_ledger, toxicity
from evstat.llm.common import table
from llm.helpers import empty_docs, hard_docs
from llm.test_neardup import brute
from llm.test_secrets import brute as secrets


def test_stages_in_order(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    docs = table(spark, SF_SMALL, "documents")
    labels = table(spark, SF_SMALL, "labels")
    kept = P.drop_toxic(spark, docs, SF_SMALL)
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~queries.held_out()))).collect()
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scored if r.score < r.score_limit)
    assert kept.columns == docs.columns

    one = P.drop_near_duplicates(spark, kept, SF_SMALL)
    before = kept.select("doc_id", "text").collect()
    smallest = defaultdict(list)
    for c, r in zip(brute([r.text for r in before]), before, strict=True):
        smallest[c].append(r.doc_id)
    assert sorted(r.doc_id for r in one.collect()) == sorted(min(x) for x in smallest.values())

    masked = P.mask_secrets(spark, one, SF_SMALL)
    old = {r.doc_id: r.text for r in one.collect()}
    new = {r.doc_id: r for r in masked.collect()}
    assert set(old) == set(new) and masked.columns == docs.columns
    assert all((new[d].text == t) == (not secrets(t)) or "[SECRET]" in new[d].text for d, t in old.items())
    assert not any(secrets(r.text) for r in new.values()) and all(r.n_chars == len(r.text) for r in new.values())

    mixed = P.mix_sources(spark, masked, SF_SMALL)
    assert mixed.columns == docs.columns
    taken = {r.doc_id: (r.mix_size, r.mix_taken) for r in mixing.mix(masked).collect()}
    rows = Counter(r.doc_id for r in mixed.collect())
    assert all(rows[d] == -(-t // s) for d, (s, t) in taken.items() if s)

    packed = P.pack_documents(spark, mixed, SF_SMALL)
    assert Counter(r.doc_id for r in packed.where("start = 0").collect()) == rows


def test_run(spark):
    out = P.run(spark, SF_SMALL)
    assert out.count() > 0 and out.select(F.max("offset")).first()[0] < 1024
    assert P.ORACLE_SQL is None


CLASHES = ["_toxic", "_toxic_limit", "score", "_dup_cid", "_dup_tie", "_k", "comp", "_secrets", "_secrets_found", "mix_size", "_mix_key", "mix_taken"]


def test_hard_tables_keep_their_other_columns(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named as the stages name theirs."""
    df = hard_docs(spark).selectExpr("*", *[f"'{c}' as `{c}`" for c in CLASHES])
    before = [r.asDict() for r in df.collect()]
    for name, stage in P.STAGES[:4]:
        df = stage(spark, df, SF_SMALL)
        rows = [r.asDict() for r in df.collect()]
        assert df.columns == [*before[0]], name
        assert all(r[c] == c for r in rows for c in CLASHES), name
        if name in ("toxicity", "near_duplicates"):
            assert all(r in before for r in rows)
            assert any(r["text"] and len(r["text"]) > 50_000 for r in rows)
        if name == "near_duplicates":                    # equal texts meet, texts without words all stay
            texts = [r["text"] for r in rows]
            assert texts.count("a b c d e f g") == 1 and texts.count(None) == 2 and len(rows) == len(before) - 2
        before = rows
    assert {r["doc_id"] for r in before if r["text"] and "token=" in r["text"]} == set()
    packed = P.pack_documents(spark, df, SF_SMALL).collect()
    assert {r.doc_id for r in packed} == {r["doc_id"] for r in before}


def test_empty_tables(spark):
    df = empty_docs(spark)
    for _, stage in P.STAGES:
        df = stage(spark, df, SF_SMALL)
        assert df.count() == 0
    assert secret_ledger.RULES[:3] == secret_ledger.BASE_RULES
