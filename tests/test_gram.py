"""Elastic net from cross-moments against MLlib, and its optimality on the rows."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from evstat.operators import gram, tune


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), float(rng.normal()), float(rng.normal(5, 3)), 2.5, str(rng.choice(list("abc"))), int(i % 4)) for i in range(600)]
    rows = [(*r, float(3 * r[1] - r[2] + {"a": 0, "b": 4, "c": -2}[r[4]] + rng.normal())) for r in rows]
    return spark.createDataFrame(rows, "id int, u double, v double, k double, c string, fold int, y double").persist()


@pytest.mark.parametrize("reg, net, intercept", [(0.0, 0.0, True), (0.3, 0.0, True), (0.3, 0.8, True), (2.0, 1.0, True), (0.3, 0.5, False), (0.0, 1.0, False)])
def test_equals_mllib(data, reg, net, intercept):
    df = VectorAssembler(inputCols=["u", "v", "k"], outputCol="f").transform(data)
    want = LinearRegression(featuresCol="f", labelCol="y", regParam=reg, elasticNetParam=net, fitIntercept=intercept, maxIter=500, tol=1e-13).fit(df)
    got = {r["slot"]: r["coefficient"] for r in gram.fit_table(df.withColumn("items", gram.items("f")), label="y", reg=reg, net=net, intercept=intercept).collect()}
    assert [got[i] for i in range(3)] == pytest.approx(want.coefficients.toArray().tolist(), abs=1e-6)
    assert got[gram.CONST] == pytest.approx(want.intercept, abs=1e-6)


def test_predictions_equal_mllib_on_hashed_rows(data):
    h = FeatureHasher(inputCols=["c", "u", "v"], outputCol="f", numFeatures=64)
    df = h.transform(data).withColumn("items", gram.items("f"))
    table = gram.fit_table(df, label="y", reg=0.1, net=0.0)
    want = LinearRegression(featuresCol="f", labelCol="y", regParam=0.1, maxIter=500, tol=1e-13).fit(df).transform(df)
    rows = want.select("prediction", gram.predict("items", table).alias("p")).collect()
    assert max(abs(r["p"] - r["prediction"]) for r in rows) < 1e-6


def test_search_ranks_as_mllib(data):
    cols, sizes = ["c", "u", "v"], [16, 64]
    regs, nets = [0.0, 0.5, 3.0], [0.0, 1.0]
    df = data
    for k in sizes:
        df = FeatureHasher(inputCols=cols, outputCol=f"f{k}", numFeatures=k).transform(df)
    fits = gram.search(df, {k: f"f{k}" for k in sizes}, "y", "fold", regs, [True, False], nets)
    rows = fits.collect()
    assert len(rows) == 4 * 2 * 12 and max(r["violation"] for r in rows) < 1e-8
    mine = [tuple(r) for r in gram.ranked(fits).orderBy("rank").collect()]
    h = FeatureHasher(inputCols=cols, outputCol="features")
    lr = LinearRegression(featuresCol="features", labelCol="y", maxIter=300, tol=1e-12)
    grid = tune.param_grid(h, lr, regs, [True, False], nets, sizes)
    cv = tune.cross_validate(Pipeline(stages=[h, lr]), grid, data, "y", folds=4, fold_col="fold")
    theirs = {tuple(r)[1:5]: r["avg_metric"] for r in tune.grid_table(data.sparkSession, cv).collect()}
    assert [r[0] for r in mine] == list(range(1, 25))
    assert all(abs(theirs[r[1:5]] - r[5]) < 1e-4 for r in mine)


def test_optimality_on_the_rows(data):
    """The gradient summed over the rows themselves, not over the moments."""
    df = VectorAssembler(inputCols=["u", "v"], outputCol="f").transform(data).withColumn("items", gram.items("f"))
    table = {r["slot"]: r["coefficient"] for r in gram.fit_table(df, label="y", reg=1.0, net=0.7).collect()}
    x = np.array([(r.u, r.v) for r in df.collect()])
    y = np.array([r.y for r in df.collect()])
    b, sd, sd_y = np.array([table[0], table[1]]), x.std(0), y.std()
    slope = -((x - x.mean(0)) / sd).T @ (y - table[-1] - x @ b) / len(y) / sd_y + 0.3 / sd_y * b * sd / sd_y
    assert np.all(b != 0) and np.abs(slope + 0.7 / sd_y * np.sign(b)).max() < 1e-9
    assert abs((y - table[-1] - x @ b).mean()) < 1e-9


def test_odd_rows(spark, data):
    df = VectorAssembler(inputCols=["u", "v", "k"], outputCol="f").transform(data)
    plain = gram.fit_table(df.withColumn("items", gram.items("f")), label="y").orderBy("slot").collect()
    more = df.unionByName(df.limit(3).withColumn("y", F.lit(float("nan")))).unionByName(df.limit(3).withColumn("y", F.lit(None).cast("double")))
    odd = more.withColumn("items", gram.items("f")).selectExpr("*", "1 as i", "2 as j", "3 as s", "4 as e", "5 as a")
    assert gram.fit_table(odd, label="y").orderBy("slot").collect() == plain
    assert plain[3]["coefficient"] == 0                         # the constant column
    none = odd.limit(0)
    assert gram.fit_table(none, label="y").count() == 0
    assert gram.search(none, {3: "f"}, "y", "fold", [0.1], [True], [0.0]).count() == 0
    flat = df.withColumn("y", F.lit(7.0)).withColumn("items", gram.items("f"))
    got = {r["slot"]: r["coefficient"] for r in gram.fit_table(flat, label="y").collect()}
    assert got == {0: 0, 1: 0, 2: 0, -1: 7.0}
