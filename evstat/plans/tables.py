"""Reading the driver's tables and the stand-in columns of FIXTURES.md §4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Stand-ins, each with its SQL twin used by the oracle.
def code_col() -> Column:
    """Nullable actor code: ``nullif(l_returnflag, 'N')`` (values A, R, null)."""
    return F.nullif(F.col("l_returnflag"), F.lit("N"))


CODE_SQL = "nullif(l_returnflag, 'N')"


def country_col() -> Column:
    """Actor country code that overlaps ``code_col``: A for open lines, R otherwise."""
    return F.when(F.col("l_linestatus") == F.lit("O"), F.lit("A")).otherwise(F.lit("R"))


COUNTRY_SQL = "case when l_linestatus = 'O' then 'A' else 'R' end"


def lineitem_key(n: int = 43) -> Column:
    """Exact shard of a line: ``l_orderkey mod n`` (SQL engines can reproduce it)."""
    return F.pmod(F.col("l_orderkey"), F.lit(n))


def events_with_gaps() -> Column:
    """``events.value`` with a null in every 17th event (exercises null binning)."""
    return F.when(F.pmod(F.col("event_id"), F.lit(17)) == 0, F.lit(None).cast("double")) \
        .otherwise(F.col("value"))


GAPS_SQL = "case when event_id % 17 = 0 then null else value end"
