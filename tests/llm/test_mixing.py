import math
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL
from evstat.llm import mixing, queries
from llm.helpers import empty_docs, hard_docs, words


def water_fill(sizes, weights=(5, 2, 1), share=1.5, stop=2):
    """Targets by resharing, step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = {s for s in open_ if unit * w[s] > stop * sizes[s]}
        if not full:
            out.update({s: unit * w[s] for s in open_})
            break
        for s in full:
            out[s] = stop * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(rows, got):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    want = water_fill(dict(sizes))
    assert len(rows) == len(got)
    taken = defaultdict(int)
    for r in got:
        assert r.mix_size == len(words(r.text)) and r.mix_source_size == sizes[r.source]
        assert math.isclose(r.mix_target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.mix_taken <= 2 * r.mix_size
        taken[r.source] += r.mix_taken
    for s, t in taken.items():
        assert want[s] - 10 <= t <= want[s] + 1e-6


@pytest.mark.parametrize("sf", [SF_SMALL, SF_ORACLE])
def test_small_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs).collect()
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], got)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    sql = con.execute(queries.ORACLE["op9_source_mix"]).fetchall()
    assert sorted(sql) == sorted(tuple(r) for r in queries.op9_source_mix(spark, sf).collect())


def test_hard_rows(spark):
    df = hard_docs(spark).withColumn("size", F.lit("x")).withColumn("key", F.lit(1)).withColumn("target", F.lit(2))
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    mixed = mixing.mix(df)
    check(rows, mixed.collect())
    out = mixing.repeat_rows(mixed, df.columns)
    assert out.columns == df.columns
    total = out.select(F.sum(mixing.size_col("text"))).first()[0]
    assert total == mixed.select(F.sum("mix_taken")).first()[0]
    assert mixing.mix(empty_docs(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r.mix_target, r.mix_taken) for r in mixing.mix(blank).collect()] == [(0.0, 0), (0.0, 0)]


def test_one_source_holds_most_rows(spark):
    rows = [(i, "w " * (i % 9), "big" if i % 3 else f"s{i % 11}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    check(rows, got)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted((r.doc_id, r.mix_taken) for r in got) == sorted((r.doc_id, r.mix_taken) for r in again)
