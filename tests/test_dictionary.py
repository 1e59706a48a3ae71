"""The distributed label dictionary against MLlib's indexer."""

import pytest
from pyspark.sql import functions as F

from evstat.operators import dictionary as D
from evstat.operators import features as feat


@pytest.fixture(scope="module")
def rows(spark):
    data = [("x" if i % 3 == 0 else f"u{i % 17}", ["b", "a", None, "ü"][i % 4], i) for i in range(900)] + [(None, "a", 900)]
    return spark.createDataFrame(data, "s string, t string, id int")


@pytest.mark.parametrize("share", [2, 20, 1000])
@pytest.mark.parametrize("mode", ["skip", "keep"])
def test_equals_mllib(rows, monkeypatch, share, mode):
    monkeypatch.setattr(D, "HOT_SHARE", share)
    d = D.label_dictionary(rows, ["s", "t"])
    got = D.with_indices(rows, d, ["s", "t"], ["si", "ti"], mode)
    want = feat.string_indexer(["s", "t"], ["si", "ti"], mode).fit(rows).transform(rows)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_unknown_labels(spark, rows):
    d = D.label_dictionary(rows, ["s"])
    n = d.count()
    new = spark.createDataFrame([("x", 1), ("never", 2), (None, 3)], "s string, _dict0_key int")
    kept = {r["_dict0_key"]: r["i"] for r in D.with_indices(new.withColumnRenamed("_dict0_key", "k"), d, ["s"], ["i"], "keep")
            .withColumnRenamed("k", "_dict0_key").collect()}
    assert kept == {1: 0.0, 2: float(n), 3: float(n)}
    assert [r.s for r in D.with_indices(new.select("s"), d, ["s"], ["i"], "skip").collect()] == ["x"]
    for label in ("never", None):
        with pytest.raises(Exception, match="not in the dictionary"):
            D.with_indices(new.where(F.col("s").eqNullSafe(F.lit(label))).select("s"), d, ["s"], ["i"]).collect()
    with pytest.raises(ValueError):
        D.with_indices(new, d, ["s"], ["i"], "other")


def test_many_labels_and_a_hot_one(spark):
    df = spark.range(0, 300_000, 1, 8).selectExpr("case when id % 3 = 0 then 'hot' else concat('v', id div 2) end as s", "id")
    d = D.label_dictionary(df, ["s"])
    top = d.where("idx < 2").orderBy("idx").collect()
    assert (top[0].value, top[0].n, top[0].idx) == ("hot", 100_000, 0.0)
    assert d.agg(F.count("*"), F.max("idx"), F.count_distinct("idx")).first()[0:3] == (d.count(), d.count() - 1.0, d.count())
    out = D.with_indices(df, d, ["s"], ["i"], "error")
    assert out.where("(s = 'hot') = (i = 0)").count() == 300_000
    assert out.join(d.select(F.col("value").alias("s"), "idx"), "s").where("i = idx").count() == 300_000


def test_empty_and_replaced_columns(spark, rows):
    none = rows.limit(0)
    d = D.label_dictionary(none, ["s", "t"])
    assert d.count() == 0
    assert D.with_indices(none, d, ["s", "t"], ["a", "b"], "keep").count() == 0
    d = D.label_dictionary(rows, ["s"])
    out = D.with_indices(rows.where("s is not null"), d, ["s"], ["s"])
    assert out.columns == ["t", "id", "s"] and out.where("s = 0").count() == rows.where("s = 'x'").count()
