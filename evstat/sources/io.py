"""Sources and sinks.

Every read and write names its path (trap T21); nothing sets the master
or touches a machine-local folder.  Writes are plain DataFrame writes,
so a lost executor only re-runs its own tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from evstat.operators.prep import ordered_limit


# ---------------------------------------------------------------- the raw event schema

# The 61 fields of the tab-separated event file, in file
# order, all nullable ("int" / "double" / "string").
EVENT_FIELDS = """
GlobalEventId int
Day int
MonthYear int
Year int
FractionDate double
Actor1Code string
Actor1Name string
Actor1CountryCode string
Actor1KnownGroupCode string
Actor1EthnicCode string
Actor1Religion1Code string
Actor1Religion2Code string
Actor1Type1Code string
Actor1Type2Code string
Actor1Type3Code string
Actor2Code string
Actor2Name string
Actor2CountryCode string
Actor2KnownGroupCode string
Actor2EthnicCode string
Actor2Religion1Code string
Actor2Religion2Code string
Actor2Type1Code string
Actor2Type2Code string
Actor2Type3Code string
IsRootEvent int
EventCode string
EventBaseCode string
EventRootCode string
QuadClass int
GoldsteinScale double
NumMentions int
NumSources int
NumArticles int
AvgTone double
Actor1Geo_Type int
Actor1Geo_Fullname string
Actor1Geo_CountryCode string
Actor1Geo_ADM1Code string
Actor1Geo_ADM2Code string
Actor1Geo_Lat string
Actor1Geo_Long string
Actor1Geo_FeatureID string
Actor2Geo_Type int
Actor2Geo_Fullname string
Actor2Geo_CountryCode string
Actor2Geo_ADM1Code string
Actor2Geo_ADM2Code string
Actor2Geo_Lat string
Actor2Geo_Long string
Actor2Geo_FeatureID string
ActionGeo_Type int
ActionGeo_Fullname string
ActionGeo_CountryCode string
ActionGeo_ADM1Code string
ActionGeo_ADM2Code string
ActionGeo_Lat string
ActionGeo_Long string
ActionGeo_FeatureID string
DATEADDED string
SOURCEURL string
"""

_TYPES = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def schema_from_text(text: str) -> T.StructType:
    """``name type`` per line to a nullable StructType."""
    fields = []
    for line in text.strip().splitlines():
        name, typ = line.split()
        fields.append(T.StructField(name, _TYPES[typ], True))
    return T.StructType(fields)


EVENT_SCHEMA = schema_from_text(EVENT_FIELDS)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA,
                   sep: str = "\t", header: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """Delimited text with a fixed schema, no inference.

    ``PERMISSIVE``: a field that does not parse and missing trailing
    fields become null.  The scan is splittable, so every executor reads
    its own byte ranges.
    """
    return (spark.read.schema(schema).option("sep", sep).option("header", header)
            .option("mode", mode).csv(path))


def write_delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = False) -> None:
    """Write delimited text (the inverse of S1, used for round trips)."""
    df.write.mode("overwrite").option("sep", sep).option("header", header).csv(path)


# ---------------------------------------------------------------- generic scans

def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = None) -> DataFrame:
    """Whole-table scan of parquet / json / orc / csv."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


# ---------------------------------------------------------------- sinks

def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] = (), header: bool = True) -> None:
    """Overwrite ``path`` with ``df``.  ``partition_by`` (e.g. the shard
    ``key``) lets later shard filters prune whole folders; rows are rebalanced on
    it first, so a folder gets a few files of a good size (AQE splits a hot key)
    and not one from every task."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", header)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def save_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a named catalog table."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def write_summary(df: DataFrame, parquet_path: str, csv_path: str) -> None:
    """A summary table to parquet and to CSV with a header (no pandas hop).

    Summaries are small (one row per group), so one CSV file is written, from
    the parquet table: the summary itself is computed once.
    """
    df.write.mode("overwrite").parquet(parquet_path)
    df.sparkSession.read.schema(df.schema).parquet(parquet_path).coalesce(1).write.mode("overwrite").option("header", True).csv(csv_path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report table (e.g. chi-square per feature) as JSON lines.

    The final aggregation keeps its own partitions; only its rows go to one task."""
    df.repartition(1).write.mode("overwrite").json(path)


# ---------------------------------------------------------------- views, cache, preview

def register_view(df: DataFrame, name: str) -> DataFrame:
    """Register a temp view; returns ``df`` for chaining."""
    df.createOrReplaceTempView(name)
    return df


def cache_view(spark: SparkSession, name: str) -> None:
    """Cache a named view for reuse (pair with ``uncache_view``)."""
    spark.catalog.cacheTable(name)


def uncache_view(spark: SparkSession, name: str) -> None:
    spark.catalog.uncacheTable(name)


def preview(df: DataFrame, n: int = 20, order: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows in a defined order (all columns by default)."""
    return ordered_limit(df, n, list(order) if order else df.columns)
