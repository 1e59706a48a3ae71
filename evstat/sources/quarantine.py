"""Delimited text with its malformed lines set aside: where they stand and what is wrong.

``PERMISSIVE`` turns what does not parse into nulls, so a shifted line looks like one with missing values.
Here every line of the files is either a row of the good table or a row of the quarantine, with its file, the byte at
which it begins, the line itself and the first reason found:

* ``fields``   it has fewer or more fields than the schema;
* ``type:<c>`` the text of field ``c`` is not of its type (an empty field is a null, and no fault);
* ``encoding`` its bytes are not UTF-8 (they are kept in ``raw``).

The lines are read as text, so the files split as usual and a task sees its own byte range.  A task counts
the bytes of its lines as they stream by; the bytes of the ranges before it in the file, one row a range, are added
by a window over the ranges of a file.  Only the quarantined lines meet that join.  The good rows are one scan without
a shuffle; the quarantine is two, one for the sizes of the ranges and one for the lines.

Lines end with ``\\n`` alone; a ``\\r`` before it is cut from the last field and counts as a byte.  There is no quoting: the
event files have none.  Cases: an empty file or folder of empty files gives two empty tables; an empty line
is a line of one field; lines may be as long as a row may be; positions hold for plain files (in a compressed
one they count the text), and a byte order mark at a file's start is not counted, as Spark's reader drops it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evstat.sources.io import EVENT_SCHEMA

RANGE = ("file", "range_start")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    meta = "_metadata.file_path AS file", "_metadata.file_block_start AS range_start"
    return spark.read.option("lineSep", "\n").text(path).selectExpr("CAST(value AS BINARY) AS raw", *meta)


def _count_bytes(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each line the bytes of its byte range before it.  The rows of a range come together and in order."""
    key, run = None, 0
    for block in blocks:
        if not block.num_rows:
            continue
        size = np.asarray(block.column("size"))
        files, starts = block.column("file").dictionary_encode(), np.asarray(block.column("range_start"))
        codes = np.asarray(files.indices)
        new = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
        at = np.empty(len(size), dtype=np.int64)
        for low, high in zip([0, *new], [*new, len(size)]):
            now = files.dictionary[codes[low]].as_py(), int(starts[low])
            run = run if now == key else 0
            key = now
            ends = run + np.cumsum(size[low:high])
            at[low:high] = ends - size[low:high]
            run = int(ends[-1])
        yield pa.RecordBatch.from_arrays([*block.columns, pa.array(at)], names=[*block.schema.names, "before"])


def _typed(text: Column, field: T.StructField) -> tuple[Column, Column]:
    """The value of a field, null if empty, and whether its text is at fault."""
    text = F.when(text != "", text)
    if isinstance(field.dataType, T.StringType):
        return text, F.lit(False)
    value = text.try_cast(field.dataType)
    return value, text.isNotNull() & value.isNull()


def read_checked(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: rows of the schema, and ``file, position, reason, raw`` of every other line."""
    text = F.col("raw").cast("string")
    fields = F.split(F.regexp_replace(text, "\r$", ""), re.escape(sep), -1)
    lines = _lines(spark, path).withColumn("fields", fields)
    reason = F.when(~F.is_valid_utf8(text), F.lit("encoding")).when(F.size("fields") != len(schema.fields), F.lit("fields"))
    values = []
    for i, f in enumerate(schema.fields):
        value, wrong = _typed(F.get(F.col("fields"), i), f)
        values.append(value.alias(f.name))
        reason = reason.when(wrong, F.lit(f"type:{f.name}"))
    lines = lines.withColumn("reason", reason)
    good = lines.where(F.col("reason").isNull()).select(*values)

    # sizes of all lines stream through the tasks; a line's bytes only if it is at fault
    sized = lines.select(F.when(F.col("reason").isNotNull(), F.col("raw")).alias("raw"), *RANGE, "reason",
                         (F.octet_length("raw") + 1).cast("long").alias("size"))
    placed = sized.mapInArrow(_count_bytes, "raw binary, file string, range_start long, reason string, size long, before long")
    faults = placed.where(F.col("reason").isNotNull())
    ranges = _lines(spark, path).groupBy(*RANGE).agg(F.sum(F.octet_length("raw") + 1).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("skip", F.coalesce(F.sum("bytes").over(earlier), F.lit(0))).drop("bytes")
    bad = faults.join(ranges, list(RANGE)).select("file", (F.col("skip") + F.col("before")).alias("position"), "reason", "raw")
    return good, bad
