"""Sources and sinks round trips."""

from pyspark.sql import functions as F

from evstat.sources import io


def test_table_formats_round_trip(spark, tmp_path):
    df = spark.range(50).select(F.col("id"), (F.col("id") % 5).alias("key"), (F.col("id") * 0.5).alias("x"))
    for fmt in ("parquet", "json", "orc"):
        path = str(tmp_path / fmt)
        io.write_table(df, path, fmt=fmt, partition_by=["key"] if fmt == "parquet" else ())
        back = io.read_table(spark, path, fmt=fmt, schema=df.schema if fmt == "json" else None)
        assert back.select("id", "key", "x").exceptAll(df.select("id", "key", "x")).count() == 0
    csv = str(tmp_path / "csv")
    io.write_table(df, csv, fmt="csv")
    back = spark.read.schema(df.schema).option("header", True).csv(csv)
    assert back.exceptAll(df).count() == 0


def test_named_table_summary_and_report(spark, tmp_path):
    df = spark.range(10).select(F.col("id"), (F.col("id") % 2).alias("g"))
    io.save_table(df, "evstat_io_test", partition_by=["g"])
    assert spark.table("evstat_io_test").count() == 10
    spark.sql("drop table evstat_io_test")
    io.write_summary(df.groupBy("g").count(), str(tmp_path / "pq"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["g", "count"]
    io.write_report(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 10


def test_view_cache_and_preview(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("v"))
    io.register_view(df, "evstat_view_test")
    io.cache_view(spark, "evstat_view_test")
    assert spark.catalog.isCached("evstat_view_test")
    io.uncache_view(spark, "evstat_view_test")
    assert not spark.catalog.isCached("evstat_view_test")
    assert [r.v for r in io.preview(df, 5).collect()] == [0, 1, 2, 3, 4]
