"""Exact splits against a plain sort, components against MLlib and numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import functions as F

from evstat.operators import comoments as C
from evstat.operators import split as S


def plain_digest(seed, *ids):
    return hashlib.md5((str(seed) + "".join("~" if x is None else f":{x}" for x in ids)).encode()).hexdigest()


def test_sizes_and_places(spark):
    df = spark.range(0, 10_007, 1, 16).select("id", F.lit("x").alias("part"))
    out = S.exact_split(df, ["id"], [0.1, 0, 0.25, 0.65])
    assert out.columns == ["id", "part"]
    got = {r.id: r.part for r in out.collect()}
    order = sorted(range(10_007), key=lambda i: plain_digest(42, i))
    cuts = S.cut_places([0.1, 0, 0.25, 0.65], 10_007)
    assert cuts == [1001, 1001, 3502]
    assert got == {i: sum(at >= c for c in cuts) for at, i in enumerate(order)}


def test_layout_does_not_matter(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("k"))
    rows = [sorted(map(tuple, S.exact_split(df.repartition(n), ["id", "k"], [1, 2], seed=5).collect())) for n in (1, 64)]
    assert rows[0] == rows[1] and sum(r[-1] == 0 for r in rows[0]) == 1000
    assert rows[0] != sorted(map(tuple, S.exact_split(df, ["id", "k"], [1, 2], seed=6).collect()))


@pytest.mark.parametrize("weights", [[1, 9], [9, 1], [1, 1], [1, 0], [0, 1]])
def test_hot_group_stays_together(spark, weights):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), F.col("id"))).alias("s"))
    out = S.exact_split(df, ["s"], weights).groupBy("s").agg(F.collect_set("part").alias("p"), F.count("*").alias("n")).collect()
    assert all(len(r.p) == 1 for r in out)
    cut, first = S.cut_places(weights, 900)[0], 0
    want = {}
    for r in sorted(out, key=lambda r: plain_digest(42, r.s)):
        begun = first >= cut or (first + r.n > cut and 2 * (cut - first) < r.n)
        want[r.s], first = int(begun), first + r.n
    assert {r.s: r.p[0] for r in out} == want


def test_nulls_empty_tables_and_errors(spark):
    df = spark.createDataFrame([(None, 1), ("", 1), ("~", 1), (None, None)], "a string, `b.c` int")
    out = S.exact_split(df, ["a", "b.c"], [1, 1])
    assert out.groupBy("part").count().orderBy("part").collect() == [(0, 2), (1, 2)]
    none = S.exact_split(df.limit(0), ["a"], [1, 1], ["p", "q"])
    assert none.count() == 0 and none.columns == ["a", "b.c", "part"]
    for bad in ([], [0, 0], [1, -1]):
        with pytest.raises(ValueError):
            S.exact_split(df, ["a"], bad)
    with pytest.raises(ValueError):
        S.exact_split(df, ["a"], [1, 1], ["one"])


def test_rows_are_not_shuffled(spark):
    plan = S.exact_split(spark.range(100), ["id"], [1, 1])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


# ---------------------------------------------------------------- components

@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(2000, 2))
    x = np.column_stack([base[:, 0] * 3 + 1e6, base[:, 0] + base[:, 1], base[:, 1] - 5, rng.normal(size=2000)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    return x, df.repartition(13)


@pytest.mark.parametrize("scale", [False, True])
def test_equals_numpy(spark, points, scale, monkeypatch):
    monkeypatch.setattr(C, "FAN", 4)
    x, df = points
    got = C.principal_components(df, df.columns, scale=scale)
    want = np.corrcoef(x.T) if scale else np.cov(x.T)
    w = got.weights
    assert got.rows == 2000 and np.all(np.diff(got.variances) <= 0)
    assert np.allclose(w @ w.T, np.eye(4), atol=1e-9)
    assert np.allclose(w.T @ np.diag(got.variances) @ w, want, rtol=1e-9, atol=1e-9)
    assert np.isclose(got.total, np.trace(want))
    assert all(r[np.argmax(np.abs(r))] > 0 for r in w)


def test_same_as_mllib_up_to_sign(spark, points):
    x, df = points
    model = PCA(k=2, inputCol="v", outputCol="p").fit(VectorAssembler(inputCols=df.columns, outputCol="v").transform(df))
    got = C.principal_components(df, df.columns, k=2)
    theirs = model.pc.toArray().T
    assert np.allclose(np.abs((theirs * got.weights).sum(axis=1)), 1, atol=1e-4)
    assert np.allclose(model.explainedVariance.toArray(), got.variances / got.total, atol=1e-4)
    assert got.table(spark).count() == 8


def test_scores_and_hard_rows(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (4.0, 4.0, 5.0), (None, 1.0, 5.0), (float("nan"), 1.0, 5.0), (1.0, float("-inf"), 5.0)]
    df = spark.createDataFrame(rows, "`x.y` double, y double, z double")
    pc = C.principal_components(df, ["x.y", "y", "z"], scale=True)
    assert pc.rows == 3 and np.allclose(pc.variances[-1], 0)
    out = df.select(*pc.scores()).collect()
    assert all(v is None for r in out[3:] for v in r)
    x = np.array(rows[:3])[:, :2] / pc.scales[:2]
    assert np.allclose([list(r) for r in out[:3]], x @ pc.weights[:, :2].T)
    for few in (df.limit(0), df.where("y = 4")):
        with pytest.raises(ValueError):
            C.principal_components(few, ["x.y", "y"])


def test_empty_partitions(spark):
    df = spark.range(40).select(F.col("id").cast("double").alias("i"), (F.col("id") % 5).alias("task")).repartition(64, "task")
    n, mean, m = C.co_moments(df, ["i", "task"])
    assert n == 40 and np.allclose(mean, [19.5, 2]) and np.allclose(m / 39, np.cov(np.arange(40), np.arange(40) % 5))
