"""Logistic fits on compressed rows against MLlib, and their optimality on the rows."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler

from evstat.operators import logit


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = np.stack([rng.integers(0, 5, 3000), rng.integers(0, 3, 3000), rng.integers(0, 2, 3000), np.full(3000, 4)], axis=1).astype(float)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 2.0 * x[:, 1] - 1)))).astype(int)
    return spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, k double, y int").persist()


@pytest.mark.parametrize("reg, net", [(0.0, 0.0), (0.05, 0.0), (0.05, 1.0), (0.1, 0.8), (0.3, 0.8), (5.0, 0.8)])
def test_equals_mllib(rows, reg, net):
    f = VectorAssembler(inputCols=["a", "b", "c", "k"], outputCol="f").transform(rows)
    want = LogisticRegression(featuresCol="f", labelCol="y", regParam=reg, elasticNetParam=net, maxIter=500, tol=1e-12).fit(f)
    got = logit.fit(rows, ["a", "b", "c", "k"], "y", reg=reg, net=net)
    assert got.coefficients == pytest.approx(want.coefficients.toArray(), abs=2e-4)
    assert got.intercept == pytest.approx(want.intercept, abs=5e-4)
    assert got.history[-1] <= want.summary.objectiveHistory[-1] + 1e-9
    assert all(x >= y for x, y in zip(got.history, got.history[1:], strict=False))
    assert got.violation <= 1e-8


def test_odd_rows(spark, rows):
    odd = rows.union(spark.createDataFrame([(None, 1.0, 1.0, 4.0, 1), (float("nan"), 1.0, 1.0, 4.0, 1), (1.0, 1.0, 1.0, 4.0, None), (1.0, 1.0, 1.0, 4.0, 2)], rows.schema))
    odd = odd.selectExpr("*", "1 as x0", "2 as n", "3 as positive", "4 as _m")
    a, b = logit.fit(rows, ["a", "b"], "y", reg=0.1), logit.fit(odd, ["a", "b"], "y", reg=0.1)
    assert a.coefficients.tolist() == pytest.approx(b.coefficients.tolist(), abs=1e-12)
    for bad in (rows.limit(0), rows.where("y = 1")):
        with pytest.raises(ValueError):
            logit.fit(bad, ["a"], "y")
    assert logit.compress(rows, ["a", "b"], "y").count() == 15
