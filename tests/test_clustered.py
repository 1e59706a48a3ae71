"""Clustered tables: right rows, few files, skipped row groups, hot values split."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evstat.sources import clustered


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i, None if i % 19 == 0 else rng.choice([7.5, rng.uniform(-10, 10), rng.uniform(-10, 10)]), rng.choice("ABCD") + str(i % 50))
            for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, score double, country string")
    path = str(tmp_path_factory.mktemp("clustered") / "t")
    clustered.write(df.repartition(5), path, ["score"], zones=["id"], bloom=["country"], files=20, row_group_bytes=4096)
    return path, rows


FILTERS = [
    [("score", ">=", 9.0)], [("score", "<", -9.5)], [("score", "=", 7.5)], [("score", ">", 2.0), ("score", "<=", 2.5)],
    [("score", "present", None), ("country", "=", "A10")], [("score", "in", [7.5, 100.0])], [("score", ">", 50.0)],
    [("id", "<", 40), ("score", "present", None)], [],
]


@pytest.mark.parametrize("filters", FILTERS)
def test_rows_are_those_of_a_full_scan(spark, table, filters):
    path, rows = table
    test = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
            ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "present": lambda a, _: True}
    at = {"id": 0, "score": 1, "country": 2}
    want = [r for r in rows if all(r[at[c]] is not None and test[op](r[at[c]], v) for c, op, v in filters)]
    got = clustered.read(spark, path, filters)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    share = clustered.read_share(spark, path, filters).first()
    assert share.rows == len(rows) and share.rows_in_files >= len(want)


def test_a_narrow_range_opens_few_files(spark, table):
    path, _ = table
    share = clustered.read_share(spark, path, [("score", ">", 2.0), ("score", "<=", 2.5)]).first()
    assert share.files == 20 and share.files_read <= 3
    assert clustered.read_share(spark, path, [("score", ">", 50.0)]).first().files_read == 0


def test_a_hot_value_spans_files(spark, table):
    path, rows = table
    hot = sum(r[1] == 7.5 for r in rows)
    files = clustered.files_for(spark, path, [("score", "=", 7.5)]).where("read")
    assert hot > 5000 and files.count() >= 6
    assert clustered.files_for(spark, path, []).agg(F.max("rows")).first()[0] < 2 * len(rows) / 20


def test_the_scan_skips_inside_files(spark, table):
    path, rows = table
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = clustered.read(spark, path, [("score", ">", 2.0), ("score", "<=", 2.1)])
        n = len(df.collect())
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        read = scan.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    opened = clustered.read_share(spark, path, [("score", ">", 2.0), ("score", "<=", 2.1)]).first().rows_in_files
    assert n <= read < opened < len(rows) / 5


def test_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([], "a int, _tie string")
    clustered.write(none, str(tmp_path / "none"), ["a"])
    got = clustered.read(spark, str(tmp_path / "none"), [("a", ">", 1)])
    assert got.schema == none.schema and got.count() == 0
    assert clustered.read_share(spark, str(tmp_path / "none"), []).first().rows == 0
    odd = spark.createDataFrame([(math.nan, "x y"), (None, None), (1.0, ""), (1.0, "")], "`a b` double, `rows` string")
    path = str(tmp_path / "with space %20")
    clustered.write(odd, path, ["a b"], zones=["rows"], files=3)
    assert sorted(r[1] for r in clustered.read(spark, path, [("a b", ">=", 1.0)]).collect()) == ["", "", "x y"]
    assert clustered.read(spark, path, [("rows", "present", None)]).count() == 3
    assert clustered.read(spark, path).count() == 4
    with pytest.raises(ValueError):
        clustered.read(spark, path, [("a b", "like", "x")])
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        clustered.write(odd, path, ["a b"])
