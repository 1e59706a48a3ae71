"""Trap tests for the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from evstat.functions import exprs as X
from evstat.operators import prep

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def bins(spark):
    rows = [(1, -5.3), (2, -3.0), (3, -1.0), (4, 1.4), (5, 11.0), (6, None), (7, NAN),
            (8, INF), (9, -INF), (10, 12.0), (11, -6.0), (12, 0.0)]
    return spark.createDataFrame(rows, "id int, x double")


CUTS = [-5.3, -3.0, -1.0, 1.4, 11.0]


def _by_id(df, col):
    return {r["id"]: r[col] for r in df.collect()}


def test_bin_ordinal_cut_values_fall_in_next_bin(bins):
    got = _by_id(bins.select("id", X.bin_ordinal("x", CUTS).alias("t")), "t")
    # x < cut: each cut value itself lands in the next bin; at or above the last cut -> default
    assert got[1] == 2 and got[2] == 3 and got[3] == 4 and got[4] == 5 and got[5] == -1
    assert got[10] == -1 and got[11] == 1 and got[12] == 4
    assert got[8] == -1 and got[9] == 1


def test_bin_ordinal_null_policies(bins):
    low = _by_id(bins.select("id", X.bin_ordinal("x", CUTS, nulls="lowest").alias("t")), "t")
    dft = _by_id(bins.select("id", X.bin_ordinal("x", CUTS, nulls="default").alias("t")), "t")
    nul = _by_id(bins.select("id", X.bin_ordinal("x", CUTS, nulls="null").alias("t")), "t")
    # Null lowest; T2: NaN also lowest (Spark alone would put NaN above every cut)
    assert low[6] == 1 and low[7] == 1
    assert dft[6] == -1 and dft[7] == -1
    assert nul[6] is None and nul[7] is None
    plain = _by_id(bins.select("id", F.when(F.col("x") < 11.0, 1).otherwise(-1).alias("t")), "t")
    assert plain[7] == -1  # NaN > 11 in Spark: why the policy exists


def test_three_and_two_way(bins):
    three = _by_id(bins.select("id", X.bin_three_way("x", 1.4, -3.0).alias("t")), "t")
    assert three[4] == "positive" and three[2] == "negative" and three[3] == "neutral"
    assert three[6] == "negative"  # null sorts lowest
    two = _by_id(bins.select("id", X.bin_two_way("x", -1.0, nulls="default").alias("t")), "t")
    assert two[3] == "positive" and two[2] == "negative" and two[6] == "invalid"
    lab = _by_id(bins.select("id", X.label_binary("x", -3.0).alias("t")), "t")
    assert lab[2] == 0 and lab[3] == 1 and lab[6] == 0


def test_cuts_must_ascend():
    with pytest.raises(ValueError):
        X.bin_ordinal("x", [1.0, 1.0])
    with pytest.raises(ValueError):
        X.bin_ordinal("x", [1.0, 2.0], nulls="bogus")


@pytest.fixture(scope="module")
def fill(spark):
    rows = [(1, "USA", "USA"), (2, "GOV", "USA"), (3, None, "USA"), (4, None, None), (5, "", "FRA")]
    return spark.createDataFrame(rows, "id int, a string, b string")


def test_fill_and_flag_use_input_row(fill):
    out = prep.add_fields(fill, {"a": X.fill_from("a", "b"), "is_same": X.same_flag("a", "b"),
                                 "b": X.fill_literal("b", "")})
    got = {r["id"]: (r["a"], r["is_same"], r["b"]) for r in out.collect()}
    assert got[1] == ("USA", True, "USA")
    assert got[2] == ("GOV", False, "USA")
    # T4: the flag sees the unfilled a, so a filled row is not "same"
    assert got[3] == ("USA", False, "USA")
    assert got[4] == (None, False, "")
    assert got[5] == ("", False, "FRA")


def test_round_half_even_and_text(spark):
    df = spark.createDataFrame([(x,) for x in (-2.5, -0.5, 0.5, 1.5, 2.5, 3.0)], "x double")
    got = [(r["r"], r["t"]) for r in df.select(X.round_half_even("x").alias("r"),
                                               X.number_to_text(X.round_half_even("x")).alias("t")).collect()]
    assert [g[0] for g in got] == [-2.0, -0.0, 0.0, 2.0, 2.0, 3.0]  # T5
    assert [g[1] for g in got] == ["-2", "0", "0", "2", "2", "3"]  # T6: no ".0"
    nan = spark.createDataFrame([(NAN,), (1.25,)], "x double").select(X.number_to_text("x").alias("t"))
    assert sorted(r["t"] for r in nan.collect()) == ["1.25", "NaN"]


def test_rescale_and_tinyint(spark):
    df = spark.createDataFrame([(-10.0,), (10.0,), (0.0,)], "x double")
    got = [r[0] for r in df.select(X.rescale("x", 10, 20)).collect()]
    assert got == [0.0, 1.0, 0.5]
    t = df.select(X.to_tinyint(F.lit(5)).alias("t")).schema["t"].dataType.simpleString()
    assert t == "tinyint"


def test_numeric_reading_skips_text(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), (None,)], "s string")
    got = [r[0] for r in df.select(X.numeric_reading("s")).collect()]
    assert got[0] == 1.5 and got[1] is None and got[2] is None
    assert not any(isinstance(g, float) and math.isnan(g) for g in got)
