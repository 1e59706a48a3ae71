"""Summaries from stored shard states, refreshed for the shards that changed (A2, A3 over shards).

A state is a row a shard and column: rows, nulls, mean, sum of squared distances from it, least and greatest value
and a quantile sketch.  States of different shards merge into those of their union, so a table's summary is a pass
over its states, a few kilobytes a shard, and a change in one shard costs a read of that shard.  The states are a committed
table (``sources.versions``) partitioned by shard: ``refresh`` replaces the folders of the shards it is given.

Moments merge as ``m2 = sum(m2_i + n_i (mean_i - mean)^2)``, with the mean found first, so no large sums are subtracted.
Quantiles come from KLL sketches and are approximate (rank error under 2 percent at their default size); all else equals
the full pass but for the last digits.

Cases: nulls and NaN are counted in ``nulls`` and take no part else; a shard without values has a state with n = 0; a
refreshed shard without rows gets that too, so its old rows are gone from the summary; a null shard is a shard in
``build`` and cannot be named in ``refresh``; an empty table has no states, and an empty summary.  The stored table
names the shard ``shard``, whatever the data calls it, so columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evstat.sources import versions

STATE = ["shard", "col", "n", "nulls", "mean", "m2", "low", "high", "sketch"]


def shard_states(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """``STATE`` columns, a row a shard and column, from one aggregate (partial in each task first)."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])
    x = F.nanvl("x", F.lit(None).cast("double"))
    return df.select(F.col(f"`{key}`").alias("shard"), F.inline(cells)).withColumn("x", x).groupBy("shard", "col").agg(
        F.count("x").alias("n"), (F.count("*") - F.count("x")).alias("nulls"), F.avg("x").alias("mean"),
        (F.var_pop("x") * F.count("x")).alias("m2"), F.min("x").alias("low"), F.max("x").alias("high"),
        F.kll_sketch_agg_double("x").alias("sketch")).select(*STATE)


def build(df: DataFrame, path: str, key: str, cols: Sequence[str]) -> int:
    """States of all shards, stored under ``path``; returns the snapshot's number."""
    return versions.overwrite(shard_states(df, key, cols), path, ["shard"])


def refresh(df: DataFrame, path: str, key: str, cols: Sequence[str], shards: Iterable) -> int:
    """New states of ``shards`` from the table ``df``, of which only those shards are read."""
    spark, shards = df.sparkSession, list(shards)
    states = shard_states(df.where(F.col(f"`{key}`").isin(shards)), key, cols)
    kind = versions.read(spark, path).schema["shard"].dataType
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(s).cast(kind) for s in shards])).alias("shard"),
                                   F.array(*[F.lit(c) for c in cols]).alias("cols")).select("shard", F.explode("cols").alias("col"))
    zero = {"n": F.coalesce("n", F.lit(0)), "nulls": F.coalesce("nulls", F.lit(0))}
    return versions.refresh(wanted.join(states, ["shard", "col"], "left").withColumns(zero).select(*STATE), path)


def merged(states: DataFrame, by: Sequence[str] = ("col",)) -> DataFrame:
    """One summary a group of ``by`` (a column; or a column and shard): count, nulls, mean, sample deviation, ends, quartiles."""
    by = list(by)
    means = states.groupBy(*by).agg((F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("centre"))
    at = F.col("n") * F.pow(F.col("mean") - F.col("centre"), 2)
    total = F.sum("n")
    sketch = F.kll_merge_agg_double("sketch")
    out = states.join(means, by).groupBy(*by).agg(
        total.alias("count"), F.sum("nulls").alias("nulls"), F.first("centre").alias("mean"),
        F.when(total > 1, F.sqrt(F.sum(F.col("m2") + at) / (total - 1))).alias("stddev"),
        F.min("low").alias("min"), F.max("high").alias("max"), sketch.alias("_sketch"))
    q = [F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(p))).alias(n)
         for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return out.select(*by, "count", "nulls", "mean", "stddev", "min", "max", *q)


def summary(spark: SparkSession, path: str) -> DataFrame:
    """The whole table's summary, a row a column, from the stored states alone."""
    return merged(versions.read(spark, path))
