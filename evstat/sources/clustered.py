"""Tables laid out by range, of which a filter reads only the files and row groups it needs.

The reference's store answers filters on its columns by indexes.  Here the rows are dealt to files by range of
the cluster columns and sorted inside each, and a zone table keeps, for every file, the rows, the nulls and the
least and greatest value of the columns that filters name.  ``read`` compares the predicates with the zones
and opens only files that can hold a match; the same predicates go to the scan, which skips the row groups (and
pages) of those files by the statistics that Parquet keeps, and by Bloom filters where a column has one.

    write(df, path, ["score"], zones=["country"], bloom=["country"])
    read(spark, path, [("score", ">=", 2.0), ("country", "=", "FRA")])

Equal rows are dealt by a tie of their own, so a value that holds a third of the rows spans files and not one
task.  Zones have a row a file; the driver receives the names of the files to read, which a scan lists there anyway.

Cases: an empty table keeps its schema; null rows come first and match no predicate; NaN is greater than any
number, as in Spark's comparisons; a predicate on a column without zones is left to the scan; an existing path is
refused, so a table is never half replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Predicate = tuple[str, str, Any]
ROW_GROUP_BYTES = 32 << 20

_TESTS = {
    "=": lambda c, v: c == F.lit(v), "<": lambda c, v: c < F.lit(v), "<=": lambda c, v: c <= F.lit(v),
    ">": lambda c, v: c > F.lit(v), ">=": lambda c, v: c >= F.lit(v), "in": lambda c, v: c.isin(*v),
    "present": lambda c, _: c.isNotNull(),
}


def _name(c: str) -> Column:
    return F.col(f"`{c}`")


# ---------------------------------------------------------------- writing

def write(df: DataFrame, path: str, cluster_by: Sequence[str], *, zones: Sequence[str] = (), bloom: Sequence[str] = (),
          files: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Writes ``df`` clustered, then the zones of its files.

    ``files`` ranges are made (by default as many as the session's shuffle partitions); ``zones`` names further columns
    to keep bounds of, ``bloom`` those with Bloom filters (equality on values spread over all files).
    """
    spark = df.sparkSession
    tie = "_tie"
    while tie in df.columns:
        tie = f"_{tie}"
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [_name(c) for c in cluster_by]
    rows = (df.withColumn(tie, F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(n, *by, _name(tie))
            .sortWithinPartitions(*by).drop(tie))
    out = rows.write.option("parquet.block.size", row_group_bytes)
    for c in bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(f"{path}/data")
    written = spark.read.schema(df.schema).parquet(f"{path}/data")
    kept = list(dict.fromkeys([*cluster_by, *zones]))
    bounds = [f(_name(c)).alias(f"{i}_{k}") for i, c in enumerate(kept)
              for k, f in (("lo", F.min), ("hi", F.max), ("filled", F.count))]
    table = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), *bounds)
    table.coalesce(1).write.parquet(f"{path}/zones")
    shape = spark.createDataFrame([(i, c) for i, c in enumerate(kept)], "at int, col string")
    shape.coalesce(1).write.parquet(f"{path}/columns")


# ---------------------------------------------------------------- reading

def _zones(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    at = {r["col"]: r["at"] for r in spark.read.parquet(f"{path}/columns").collect()}
    return spark.read.parquet(f"{path}/zones"), at


def _may_hold(i: int, op: str, value: Any) -> Column:
    """Whether a file with these bounds can hold a row that passes."""
    lo, hi = F.col(f"{i}_lo"), F.col(f"{i}_hi")
    if op == "present":
        return F.col(f"{i}_filled") > 0
    if op == "in":
        test = F.lit(False)
        for v in value:
            test = test | ((lo <= F.lit(v)) & (hi >= F.lit(v)))
        return test
    return {"=": (lo <= F.lit(value)) & (hi >= F.lit(value)), "<": lo < F.lit(value), "<=": lo <= F.lit(value),
            ">": hi > F.lit(value), ">=": hi >= F.lit(value)}[op]


def _checked(predicates: Sequence[Predicate]) -> list[Predicate]:
    for _, op, _ in predicates:
        if op not in _TESTS:
            raise ValueError(f"unknown comparison {op!r}; one of {sorted(_TESTS)}")
    return list(predicates)


def files_for(spark: SparkSession, path: str, predicates: Sequence[Predicate]) -> DataFrame:
    """Every file with ``rows`` and ``read``: whether the predicates need it."""
    zones, at = _zones(spark, path)
    need = F.lit(True)
    for c, op, v in _checked(predicates):
        if c in at:
            need = need & F.coalesce(_may_hold(at[c], op, v), F.lit(False))
    return zones.select("file", "rows", need.alias("read"))


def read(spark: SparkSession, path: str, predicates: Sequence[Predicate] = ()) -> DataFrame:
    """The rows that pass all ``(column, comparison, value)``, from the files that can hold one."""
    schema = spark.read.parquet(f"{path}/data").schema
    found = [unquote(r["file"]) for r in files_for(spark, path, predicates).where("read").select("file").collect()]
    rows = _scan(spark, schema, found)
    for c, op, v in _checked(predicates):
        rows = rows.where(_TESTS[op](_name(c), v))
    return rows


def _scan(spark: SparkSession, schema: T.StructType, files: Sequence[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    escaped = ["".join(f"\\{c}" if c in "{}[]*?\\" else c for c in f) for f in files]
    return spark.read.schema(schema).parquet(*sorted(escaped))


def read_share(spark: SparkSession, path: str, predicates: Sequence[Predicate]) -> DataFrame:
    """One row: ``files``, ``files_read``, ``rows`` and ``rows_in_files`` (rows of the files that a read opens)."""
    read_it = F.col("read")
    return files_for(spark, path, predicates).agg(
        F.count("*").alias("files"), F.count_if(read_it).alias("files_read"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(read_it, F.col("rows"))), F.lit(0)).alias("rows_in_files"))
