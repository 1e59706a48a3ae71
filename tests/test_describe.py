"""Summaries, quantiles and histograms against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evstat.operators import describe, histogram
from evstat.operators.quantiles import exact_quantiles, exact_quantiles_multi


def test_one_row_group_sample_vs_population(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0), (None, 5.0), ("c", None)],
                               "g string, x double")
    m = describe.grouped_moments(df, "g", {"x": ["var_samp", "stddev_pop"]})
    got = {r["g"]: r for r in m.collect()}
    assert got["a"]["var_samp_x"] is None and got["a"]["stddev_pop_x"] == 0.0  # T12
    assert got["b"]["var_samp_x"] == 2.0
    assert got[None]["n"] == 1  # null is a group
    assert got["c"]["var_samp_x"] is None  # all-null group


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(7)
    vals = [rnd.gauss(0, 1) for _ in range(3000)] + [0.5] * 1500  # a hot value holding a third
    df = spark.createDataFrame([(v,) for v in vals] + [(None,), (float("nan"),)], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, "x", probs)
    want = np.quantile(np.array(vals), probs, method="linear")
    for g, w in zip(got, want):
        assert math.isclose(g, w, rel_tol=1e-12, abs_tol=1e-12)


def test_exact_quantiles_infinities_and_constants(spark):
    df = spark.createDataFrame([(float("-inf"), 2.0), (1.0, 2.0), (2.0, 2.0), (float("inf"), 2.0)],
                               "x double, y double")
    got = exact_quantiles_multi(df, ["x", "y"], [0.0, 0.5, 1.0])
    assert got["x"][0] == float("-inf") and got["x"][1] == 1.5 and got["x"][2] == float("inf")
    assert got["y"] == [2.0, 2.0, 2.0]
    empty = df.where("x > 1e308 and x < 0")
    assert exact_quantiles(empty, "x", [0.5]) == [None]


def test_summary_exact_text_column_is_skipped_not_raised(spark):
    df = spark.createDataFrame([("1", 1.0), ("x", 2.0), (None, 3.0), ("3", 4.0)], "s string, v double")
    s = {r["summary"]: r for r in describe.summary_exact(df).collect()}
    assert s["count"]["s"] == 3.0 and s["mean"]["s"] == 2.0  # T16: 'x' skipped
    assert s["50%"]["v"] == 2.5 and s["min"]["v"] == 1.0 and s["max"]["v"] == 4.0


EDGES = [-1.0, -0.5, 0.0, 0.5, 1.0]


def test_histogram_edges_and_last_bin(spark):
    xs = [-1.0, 1.0, -1.0000001, 1.0000001, -0.5, 0.25, None, float("nan"), 0.4999999, 0.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [(r.bin_start, r.n) for r in histogram.histogram(df, "x", EDGES).orderBy("bin_start").collect()]
    # [a,b) except last [a,b]; outside, null and NaN dropped; empty bins kept
    assert got == [(-1.0, 1), (-0.5, 1), (0.0, 2), (0.5, 2)]
    out = histogram.outside_counts(df, "x", EDGES).first()
    assert (out.under, out.over, out.missing) == (1, 1, 2)


def test_histogram_matches_rdd_histogram(spark):
    rnd = random.Random(3)
    xs = [rnd.uniform(-20, 25) for _ in range(5000)] + [e for e in histogram.HALF_EDGES]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    ours = [r.n for r in histogram.histogram(df, "x", histogram.HALF_EDGES).orderBy("bin_start").collect()]
    ref = df.rdd.map(lambda r: r.x).histogram(histogram.HALF_EDGES)[1]
    assert ours == ref


def test_histogram_uneven_edges(spark):
    edges = [0.0, 1.0, 10.0, 100.0]
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 9.99, 10.0, 100.0, 101.0)], "x double")
    got = [r.n for r in histogram.histogram(df, "x", edges).orderBy("bin_start").collect()]
    assert got == [2, 2, 2]


def test_histograms_share_axis_in_one_scan(spark):
    df = spark.createDataFrame([(0.1, 0.9), (0.2, 5.0)], "a double, b double")
    h = histogram.histograms(df, ["a", "b"], [0.0, 0.5, 1.0])
    got = {(r.column, r.bin_start): r.n for r in h.collect()}
    assert got == {("a", 0.0): 2, ("a", 0.5): 0, ("b", 0.0): 0, ("b", 0.5): 1}


def test_shared_edge_constants():
    assert len(histogram.SHARED_EDGES) == 248 and histogram.SHARED_EDGES[-1] == 15.875
    assert len(histogram.HALF_EDGES) == 62 and histogram.HALF_EDGES[-1] == 20.5
    assert histogram.edges_by_step(-10, 20.5, 0.5) == histogram.HALF_EDGES


def test_shard_summary_recombines(spark):
    df = spark.range(4300).select((F.col("id") % 43).alias("key"),
                                  (F.col("id") * 0.5).alias("AvgTone"), (F.col("id") % 7).cast("double").alias("GoldsteinScale"))
    s = describe.shard_summary(df)
    assert s.count() == 43 and s.agg(F.sum("count")).first()[0] == 4300


def test_uneven_edges_match_rdd_histogram(spark):
    rnd = random.Random(11)
    edges = sorted(set([round(rnd.uniform(-50, 50), 3) for _ in range(37)]))
    xs = [rnd.uniform(-60, 60) for _ in range(4000)] + edges
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    ours = [r.n for r in histogram.histogram(df, "x", edges).orderBy("bin_start").collect()]
    assert ours == df.rdd.map(lambda r: r.x).histogram(edges)[1]


def test_many_ranks_many_columns_match_numpy(spark):
    rnd = random.Random(21)
    n = 2500
    cols = {
        "a": [rnd.gauss(0, 1) for _ in range(n)],
        "b": [float(rnd.randint(0, 6)) for _ in range(n)],              # heavy ties
        "c": [rnd.expovariate(0.01) ** 2 for _ in range(n)],             # long tail
        "d": [1e-9 * rnd.random() + (5.0 if i % 3 else -5.0) for i in range(n)],  # two tight clusters
    }
    df = spark.createDataFrame(list(zip(*cols.values())), "a double, b double, c double, d double")
    probs = [i / 20 for i in range(21)]
    got = exact_quantiles_multi(df, list(cols), probs)
    for c, xs in cols.items():
        want = np.quantile(np.array(xs), probs, method="linear")
        for g, w in zip(got[c], want):
            assert math.isclose(g, w, rel_tol=1e-12, abs_tol=1e-15), (c, g, w)


def test_quantiles_of_extreme_doubles(spark):
    """Both ends of the double range, infinities, and hot values: comparisons only."""
    inf = float("inf")
    for values in ([-1.7e308, 1.0, 2.0, 3.0, 1.7e308], [-inf, -1.7e308, 0.0, 1.7e308, inf, inf], [5e-324, 0.0, -5e-324], [7.0] * 9):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        probs = [0.0, 0.25, 0.5, 0.9, 1.0]
        s = sorted(values)
        for p, got in zip(probs, exact_quantiles(df, "x", probs), strict=True):
            at = p * (len(s) - 1)
            a, b, f = s[int(at)], s[min(int(at) + 1, len(s) - 1)], at % 1
            assert got == (a if f == 0 or a == b else pytest.approx(a * (1 - f) + b * f)) or (math.isinf(a) or math.isinf(b))


@pytest.mark.parametrize("brackets", [[], [(40.0, 41.0)], [(-1.0, -0.5), (99.0, 120.0)], [(10.0, 20.0), (15.0, 30.0)]])
def test_brackets_that_miss_are_widened(spark, monkeypatch, brackets):
    """Whatever the sketch says, the ranks are exact."""
    from evstat.operators import quantiles
    df = spark.range(0, 1000, 1, 5).selectExpr("cast(id % 100 as double) as x", "cast(-id as double) as y")
    wanted = {0: {0, 1, 250, 499, 999}, 1: {0, 500, 999}}
    got = quantiles.select_ranks(df, ["x", "y"], wanted, {0: brackets or [(50.0, 50.0)], 1: [(-3.0, -2.0)]})
    assert got == {**{(0, r): float(r // 10) for r in wanted[0]}, **{(1, r): float(r - 999) for r in wanted[1]}}


def test_two_reads_of_a_large_column(spark, monkeypatch):
    """Above the size that is sorted whole, one sketch and one count suffice; most rows never leave their task."""
    from evstat.operators import quantiles
    monkeypatch.setattr(quantiles, "WHOLE", 100)
    seen = []
    real = quantiles._counted
    monkeypatch.setattr(quantiles, "_counted", lambda *a: seen.append(real(*a)) or seen[-1])
    df = spark.range(0, 200_000, 1, 6).selectExpr("case when id % 3 = 0 then 5.0 else cast(hash(id) as double) end as x")
    probs = [0.01, 0.25, 0.5, 0.99]
    want = np.quantile(np.array([r.x for r in df.collect()]), probs)
    assert exact_quantiles(df, "x", probs) == pytest.approx(want.tolist(), rel=1e-12)
    assert len(seen) == 1 and seen[0].count() < 1000
