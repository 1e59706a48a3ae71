"""Operators 8 and 10: held-out accuracy, and the chain and network against plain forms."""

import itertools
import time

import numpy as np
import pytest

from conftest import SF_ORACLE, SF_SMALL
from evstat.llm import crf_quality as Q
from evstat.llm import queries
from evstat.llm import toxicity as T
from evstat.llm.common import labelled_sample, trained
from llm.helpers import HARD_TEXTS, empty_docs, hard_docs


def held(spark, query, label):
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    rows = query(spark, SF_ORACLE).join(labels, "doc_id").where("held_out").collect()
    assert rows and all(0 <= r.score <= 1 for r in rows)
    return np.array([(r[label], r.predicted) for r in rows])


def test_quality_held_out(spark):
    y = held(spark, queries.op8_crf_quality, "quality")
    assert (y[:, 0] == y[:, 1]).mean() > 0.95


def test_toxicity_held_out(spark):
    y = held(spark, queries.op10_toxicity_cnn, "toxic")
    assert (y[:, 0] == y[:, 1]).mean() > max((y[:, 0] == 0).mean(), 0.85) and y[y[:, 0] == 0, 1].mean() < 0.03


def test_every_document_is_scored(spark):
    for q in (queries.op8_crf_quality, queries.op10_toxicity_cnn):
        rows = q(spark, SF_SMALL).collect()
        assert len({r.doc_id for r in rows}) == len(rows) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def buffers(texts):
    b = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(b), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in b])]).astype(np.int64)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    m = Q.Model(unary=rng.normal(size=3), trans=rng.normal(size=(2, 2)))
    first = np.array([0, 4, 4, 5, 8])
    x = rng.normal(size=(8, 3))
    good, moves, log_z = Q.marginals(m, x, first)
    want, total = np.zeros(8), 0.0
    for a, b in itertools.pairwise(first):
        if a == b:
            continue
        z = []
        for y in itertools.product((0, 1), repeat=b - a):
            z.append((np.exp(sum(v * (x[a + i] @ m.unary) for i, v in enumerate(y)) + sum(m.trans[p, q] for p, q in itertools.pairwise(y))), y))
        s = sum(w for w, _ in z)
        total += np.log(s)
        for i in range(b - a):
            want[a + i] = sum(w for w, y in z if y[i]) / s
    assert np.allclose(good, want) and abs(total - log_z) < 1e-9 and abs(moves.sum() - 5) < 1e-9


def test_batches_score_like_single_texts():
    texts = [*HARD_TEXTS, "you idiot scum", "idiot", "a b", *["x " * n for n in range(6)]]
    rng = np.random.default_rng(0)
    tox = T.Model(emb=rng.normal(size=(T.BUCKETS, T.DIM)).astype(np.float32),
                  conv=[rng.normal(size=(w * T.DIM, T.FILTERS)).astype(np.float32) for w in T.WIDTHS],
                  cbias=[rng.normal(size=T.FILTERS).astype(np.float32) for _ in T.WIDTHS],
                  out=rng.normal(size=T.FILTERS * 3).astype(np.float32), bias=-0.3)
    crf = Q.Model(unary=rng.normal(size=3 * Q.OWN + 1), trans=rng.normal(size=(2, 2)), scale=(2.0, -1.0), empty=0.4)
    for mod, m in ((T, tox), (Q, crf)):
        whole = mod.score_texts(m, *buffers(texts))
        assert np.allclose(whole, [mod.score_texts(m, *buffers([t]))[0] for t in texts], atol=1e-5)
    # a long text is scored in pieces: the same as at once
    rows, _ = T.word_buckets(*buffers([HARD_TEXTS[12]]))
    assert len(rows) == 20_000
    old, T._PIECE = T._PIECE, 700
    try:
        a = T.score_texts(tox, *buffers([HARD_TEXTS[12]]))
    finally:
        T._PIECE = old
    assert np.allclose(a, T.score_texts(tox, *buffers([HARD_TEXTS[12]])), atol=1e-5)


def test_hard_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(6, 1, 0), (7, 0, 1), (None, 1, 0), (9, None, None), (6, 1, 0)], none.schema)
    for labels in (none, one):
        for df in (hard_docs(spark), empty_docs(spark)):
            df = df.withColumnRenamed("source", "y")
            q = Q.score(df, Q.fit(df, labels))
            t = T.score(df, T.fit(df, labels))
            assert q.count() == t.count() == df.count()
            assert q.columns == [*df.columns, "score"]
            assert all(0 <= r.score <= 1 for r in [*q.collect(), *t.collect()])


def test_limits_follow_language():
    s = np.array([0.9, 0.8, 0.2, 0.1, 0.5, 0.45, 0.1, 0.2])
    y = np.array([1, 1, 0, 0, 1, 1, 0, 0])
    limits = T.calibrate(s, y, ["en"] * 4 + ["de"] * 3 + [None])
    assert limits["en"] > 0.5 >= limits["de"] and None in limits and 0.2 < limits[None] <= 0.45


def test_one_huge_text_a_label_costs_only_itself(spark):
    first = {}      # the id of each label that comes first by hash
    for r in spark.range(40).selectExpr("id", "id % 2 as y", "xxhash64(cast(id as string), 'train') as h").orderBy("h").collect():
        first.setdefault(r.y, r.id)
    rows = [(i, "long " * 2000 if i in first.values() else f"text {i}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    got = labelled_sample(df.select("doc_id", "text"), df.select("doc_id", "y"), "y", 40, 10_000).collect()
    assert sorted(r.text for r in got) == sorted(t for i, t, _ in rows if i not in first.values())


def test_training_runs_apart(spark):
    """The model comes back from a process of its own, and so does what it raises."""
    sample = spark.createDataFrame([(i % 2, i, f"t{i}", None) for i in range(9)], "y int, h long, text string, lang string")
    assert trained(sample, lambda rows: [(r["y"], r["h"]) for r in rows]) == [(1, h) for h in (1, 3, 5, 7)] + [(0, h) for h in (0, 2, 4, 6, 8)]
    assert trained(sample.limit(0), len) == 0

    def fails(rows):
        raise ValueError("no such thing")
    with pytest.raises(Exception, match="no such thing"):
        trained(sample, fails)


def test_all_labelled_rows_teach(spark):
    """Each mark is in two texts of 240: a sample of 60 rows misses most of them, shards of 60 rows none."""
    rng = np.random.default_rng(3)
    fill = lambda: " ".join(rng.choice(["river", "stone", "field", "bread", "window", "garden"], 12))
    bad = [f"{a}{b}zq" for a in ("kra", "vom", "pel", "dus", "gri", "nak", "tol", "fyx") for b in ("om", "ip", "ul", "et", "ax")]
    rows = [(i, f"{fill()} {bad[i % 40]} {fill()}", "en", 1) for i in range(80)] + [(100 + i, f"{fill()} {fill()}", None, 0) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = T.fit(df.drop("toxic"), df.select("doc_id", "toxic"), rows=60)
    new = spark.createDataFrame([(x, f"{fill()} {x} {fill()}") for x in bad] + [("", f"{fill()} {fill()}")] * 20, "mark string, text string")
    got = [(r.mark != "", r.score) for r in T.score(new, model).collect()]
    caught = [s >= model.limits[None] for mark, s in got if mark]
    assert len(caught) == 40 and sum(caught) >= 36 and not any(s >= model.limits[None] for mark, s in got if not mark)


def test_limits_count_every_row(spark):
    rows = [(i, "calm river text" if i % 3 else "awful scum text", "en" if i % 2 else None, int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, y int")
    model = T.train([r[1] for r in rows], np.array([r[3] for r in rows]))
    s = [r.score for r in T.score(df, T._calibrated(df, model)).orderBy("doc_id").collect()]
    assert T._calibrated(df, model).limits == T.calibrate(np.array(s), np.array([r[3] for r in rows]), [r[2] for r in rows])


def test_dead_filters_are_zero():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "b", "c", "scum"], 6)) for _ in range(400)]
    m = T.train(texts, np.array([int("scum" in t) for t in texts]))
    assert all(((np.abs(w) >= T.TINY) | (w == 0)).all() for w in T._dense(m))


def test_sharded_training_leaves_no_weights_on_the_driver(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50} " + ("idiot scum" if i % 4 == 0 else "fine day"), "en") for i in range(400)],
                                 "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().memoryStore()
    before = store.memoryUsed()
    model = T.fit(docs, labels, rows=100)
    end = time.time() + 20
    while store.memoryUsed() - before > 4_000_000 and time.time() < end:      # blocks go in the background
        time.sleep(0.2)
    assert store.memoryUsed() - before <= 4_000_000                           # the weights are 8 MB, once an epoch
    assert model.emb.shape == (T.BUCKETS, T.DIM) and set(model.limits) == {None, "en"}


def test_tasks_get_the_model_from_the_buckets_that_differ():
    drawn = 10, 4, 7
    m, unseen = T._unseen(*drawn), T._unseen(*drawn)
    adam = T._Adam.of(m)
    assert len(T._packed(m, adam, unseen, drawn)[1]) == 0
    m.emb[5] += 1
    m.emb[T.BUCKETS - 1, 0] = -0.25
    adam.emb_var[9] = 2
    m.conv[1] += 0.5
    m.bias, adam.step = 0.125, 77
    packed = T._packed(m, adam, unseen, drawn)
    assert packed[1].tolist() == [5, 9, T.BUCKETS - 1]
    m2, adam2 = T._unpacked(packed)
    assert (m2.emb == m.emb).all() and (adam2.emb_var == adam.emb_var).all() and (T._flat(m2, adam2) == T._flat(m, adam)).all()
