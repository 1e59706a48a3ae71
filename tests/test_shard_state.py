"""Merged shard states against full passes."""

import pytest
from pyspark.sql import functions as F

from evstat.operators import shard_state as S
from evstat.sources import versions as V


def plain(df, cols):
    out = {}
    for c in cols:
        x = F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
        out[c] = df.agg(F.count(x), F.count("*") - F.count(x), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)).first()
    return out


def check(got, df, cols):
    got = {r["col"]: r for r in got.collect()}
    want = plain(df, cols)
    assert set(got) == set(cols)
    for c, w in want.items():
        g = got[c]
        assert (g["count"], g["nulls"], g["min"], g["max"]) == (w[0], w[1], w[4], w[5])
        assert g["mean"] == pytest.approx(w[2], rel=1e-12) and g["stddev"] == pytest.approx(w[3], rel=1e-9)


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(0, 9000, 1, 6).select(
        F.when(i % 3 == 0, F.lit(0)).otherwise(i % 17).cast("int").alias("n"), (1e9 + i * 0.37).alias("a.b"),
        F.when(i % 5 == 0, None).when(i % 7 == 0, float("nan")).otherwise(F.sin(i)).alias("shard"))


COLS = ["a.b", "shard"]


def test_whole_and_refreshed(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    S.build(rows, path, "n", COLS)
    check(S.summary(spark, path), rows, COLS)
    changed = rows.withColumn("a.b", F.when(F.col("n").isin(3, 5), F.col("`a.b`") - 7).otherwise(F.col("`a.b`"))).where("n <> 9")
    S.refresh(changed, path, "n", COLS, [3, 5, 9])
    check(S.summary(spark, path), changed, COLS)
    old, new = (V._load(spark, path, n)["folders"] for n in (1, 2))
    assert len(set(old) & set(new)) == len(old) - 3


def test_refresh_reads_its_shards_only(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    S.build(rows, path, "n", ["a.b"])
    guarded = rows.withColumn("a.b", F.when(F.col("n") != 4, F.raise_error(F.lit("read")).cast("double")).otherwise(0.0))
    S.refresh(guarded, path, "n", ["a.b"], [4])
    got = S.summary(spark, path).first()
    assert got["min"] == 0 and got["count"] == 9000


def test_quartiles_near_their_ranks(spark, rows, tmp_path):
    r = S.merged(S.shard_states(rows, "n", ["a.b"])).first()
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert abs(rows.where(F.col("`a.b`") <= r[name]).count() / 9000 - p) < 0.02


def test_by_shard_and_hard_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 3.0), ("b", float("nan"))], "k string, x double")
    got = {r.shard: r for r in S.merged(S.shard_states(df, "k", ["x"]).where("shard is not null"), ["shard", "col"]).collect()}
    assert (got["a"]["count"], got["a"]["nulls"], got["a"]["mean"], got["a"]["stddev"]) == (1, 1, 1.0, None)
    assert (got["b"]["count"], got["b"]["nulls"], got["b"]["mean"], got["b"]["q1"]) == (0, 1, None, None)
    assert S.merged(S.shard_states(df, "k", ["x"])).first()["count"] == 2
    assert S.merged(S.shard_states(df.limit(0), "k", ["x"])).count() == 0
