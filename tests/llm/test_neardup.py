from collections import Counter

import numpy as np
import pytest

from conftest import SF_SMALL
from evstat.llm import neardup
from llm.helpers import empty_docs, hard_docs, words


def bag(text):
    w = words(text)
    if 0 < len(w) < 5:
        return Counter([tuple(w)])
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def brute(texts):
    """Class number of each text by all pairs (texts without words stand alone)."""
    bags = [bag(t) for t in texts]
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and root(i) != root(j):
                n, m = sum(bags[i].values()), sum(bags[j].values())
                if min(n, m) >= 0.8 * max(n, m) and similarity(bags[i], bags[j]) >= 0.8:
                    comp[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def partition(ids, classes):
    out = {}
    for i, c in zip(ids, classes, strict=True):
        out.setdefault(c, set()).add(i)
    return sorted(map(sorted, out.values()))


def test_small_corpus(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = neardup.near_dups(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()
    assert partition([r.doc_id for r in got], [r.class_id for r in got]) \
        == partition([d.doc_id for d in docs], brute([d.text for d in docs]))
    sizes = Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] and r.keep == (r.doc_id == r.class_id) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_edits(spark, seed):
    """Chains in which only neighbours are similar, one big group around a base, and
    strangers that share a passage."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 50_000, n)]
    texts = []
    for _ in range(4):
        t = word(120)
        for _ in range(8):
            texts.append(" ".join(t))
            t = list(t)
            t[int(rng.integers(0, 120))] = word(1)[0]
    base = word(100)
    for _ in range(60):
        t = list(base)
        for _ in range(int(rng.integers(0, 3))):
            t[int(rng.integers(0, 100))] = word(1)[0]
        texts.append(" ".join(t))
    passage = word(60)
    texts += [" ".join(word(30) + passage + word(30)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = neardup.near_dups(df).collect()
    assert partition([r.doc_id for r in got], [r.class_id for r in got]) == partition(range(len(texts)), brute(texts))


def test_signatures_estimate_similarity():
    a = " ".join(f"w{i}" for i in range(300))
    b = " ".join(f"w{i}" if i % 60 else f"z{i}" for i in range(300))
    data = np.frombuffer((a + b).encode(), np.uint8)
    units, doc = neardup.bag_units(data, np.array([0, len(a), len(a) + len(b)]))
    sig = neardup.dart_signatures(units, doc, 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - similarity(bag(a), bag(b))) < 0.04


def test_hard_rows(spark):
    df = hard_docs(spark)
    got = neardup.near_dups(df.withColumnRenamed("lang", "cid")).collect()
    assert len(got) == df.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.class_id for r in by[6] + by[7]} == {6} and by[7][0].class_size == 3
    assert all(by[i][0].class_id == i for i in (0, 1, 2, 3, 4, 5))     # no words, or other words
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and {0, 1, 2, 3} <= set(ids)


def test_empty(spark):
    assert neardup.near_dups(empty_docs(spark)).count() == 0
    assert neardup.keep_one(empty_docs(spark)).count() == 0
