"""A hot key holding a third of all rows: results equal brute force (pandas)."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evstat.operators import chisq, describe, histogram


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(9000):
        key = "HOT" if i % 3 == 0 else f"k{rnd.randint(0, 300)}"
        rows.append((key, rnd.gauss(0, 5), "pos" if rnd.random() < 0.4 + (0.1 if key == "HOT" else 0) else "neg"))
    pdf = pd.DataFrame(rows, columns=["k", "x", "label"])
    return spark.createDataFrame(pdf).repartition(8), pdf


def test_grouped_moments_hot_key(skewed):
    df, pdf = skewed
    got = {r.k: r for r in describe.grouped_moments(df, "k", {"x": ["mean", "var_samp"]}).collect()}
    want = pdf.groupby("k")["x"].agg(["mean", "var", "count"])
    assert got["HOT"].n == 3000
    for k, row in want.iterrows():
        assert got[k].n == row["count"]
        assert math.isclose(got[k].mean_x, row["mean"], rel_tol=1e-9, abs_tol=1e-12)
        if row["count"] > 1:
            assert math.isclose(got[k].var_samp_x, row["var"], rel_tol=1e-9)


def test_chi_square_hot_value(skewed):
    df, pdf = skewed
    got = chisq.chi_square(df, ["k"], "label").first()
    obs = pd.crosstab(pdf["k"], pdf["label"]).to_numpy().astype(float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    assert math.isclose(got.statistic, float(((obs - exp) ** 2 / exp).sum()), rel_tol=1e-9)
    assert got.dof == (obs.shape[0] - 1) * (obs.shape[1] - 1)


def test_histogram_hot_bin(skewed):
    df, pdf = skewed
    hot = df.withColumn("x", F.when(F.col("k") == "HOT", F.lit(0.25)).otherwise(F.col("x")))
    edges = histogram.HALF_EDGES
    got = [r.n for r in histogram.histogram(hot, "x", edges).orderBy("bin_start").collect()]
    xs = np.where(pdf["k"] == "HOT", 0.25, pdf["x"])
    assert got == hot.rdd.map(lambda r: r.x).histogram(edges)[1]
    assert max(got) >= 3000 and sum(got) == int(((xs >= edges[0]) & (xs <= edges[-1])).sum())
