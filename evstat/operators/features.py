"""Feature preparation with MLlib stages.

Thin, parameterised constructors with the reference's settings as
defaults, plus DataFrame forms of the two stages an oracle can check
(string index order, standard scaling).  Every stage runs distributed:
``StringIndexer.fit`` is one aggregate of label counts, ``StandardScaler``
one pass of column moments, ``FeatureHasher`` is map-only.

High-cardinality columns: ``StringIndexer`` keeps its label list on the
driver, so for columns with unbounded distinct values use
``hasher`` (M4), which needs no fit at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (PCA, FeatureHasher, StandardScaler, StringIndexer,
                                VectorAssembler, VectorIndexer)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evstat.session import reliable_checkpoint


def string_indexer(cols: Sequence[str] | str, outs: Sequence[str] | str | None = None,
                   handle_invalid: str = "error", order: str = "frequencyDesc") -> StringIndexer:
    """M1/M2: index one or several string columns (frequency desc, ties by label asc)."""
    if isinstance(cols, str):
        return StringIndexer(inputCol=cols, outputCol=outs or f"{cols}_idx",
                             handleInvalid=handle_invalid, stringOrderType=order)
    cols = list(cols)
    outs = list(outs) if outs else [f"{c}_idx" for c in cols]
    return StringIndexer(inputCols=cols, outputCols=outs, handleInvalid=handle_invalid,
                         stringOrderType=order)


def assembler(cols: Sequence[str], out: str = "features", handle_invalid: str = "error") -> VectorAssembler:
    """M3: numbers / indices / booleans to one vector column."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid)


def hasher(cols: Sequence[str], out: str = "features", num_features: int = 1000,
           categorical: Sequence[str] = ()) -> FeatureHasher:
    """M4: hash mixed string / numeric columns into ``num_features`` slots (no fit)."""
    h = FeatureHasher(inputCols=list(cols), outputCol=out, numFeatures=num_features)
    if categorical:
        h.setCategoricalCols(list(categorical))
    return h


def scaler(inp: str = "features", out: str = "scaled", with_mean: bool = False,
           with_std: bool = True) -> StandardScaler:
    """M5: unit sample stddev, no centring (MLlib defaults)."""
    return StandardScaler(inputCol=inp, outputCol=out, withMean=with_mean, withStd=with_std)


def pca(k: int = 5, inp: str = "features", out: str = "pca") -> PCA:
    """M6: principal components (the covariance is a k x k-sized driver object per
    feature count, not per row)."""
    return PCA(k=k, inputCol=inp, outputCol=out)


def vector_indexer(inp: str = "features", out: str = "indexed", max_categories: int = 20) -> VectorIndexer:
    """M7: mark low-cardinality vector slots as categorical."""
    return VectorIndexer(inputCol=inp, outputCol=out, maxCategories=max_categories)


def pipeline(stages: Sequence) -> Pipeline:
    """M8: a staged pipeline (fit all, then transform)."""
    return Pipeline(stages=list(stages))


def stage_of_type(model: PipelineModel, cls: type):
    """M9: first fitted stage of a given type."""
    for s in model.stages:
        if isinstance(s, cls):
            return s
    raise LookupError(f"no stage of type {cls.__name__}")


def index_and_assemble(features: Sequence[str], label: str | None = None,
                       out: str = "features", label_out: str = "label",
                       handle_invalid: str = "keep") -> list:
    """Stages used by the chi-square and classifier jobs: index each feature
    (keeping unseen / null as an extra index), index the label, assemble."""
    idx_cols = [f"_{i}_idx" for i in range(len(features))]
    stages = [string_indexer(list(features), idx_cols, handle_invalid)]
    if label is not None:
        stages.append(string_indexer(label, label_out))
    stages.append(assembler(idx_cols, out, handle_invalid))
    return stages


def vector_columns(v: str | Column, n: int, prefix: str = "f") -> list[Column]:
    """Expose the first ``n`` vector slots as double columns ``f0..f{n-1}``."""
    arr = vector_to_array(F.col(v) if isinstance(v, str) else v)
    return [arr[i].alias(f"{prefix}{i}") for i in range(n)]


# ---------------------------------------------------------------- DataFrame forms (oracle-checkable)

def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """0-based position of every row in a global order, without a one-task window.

    ``orderBy`` range-partitions the rows (partition ``i`` holds only rows
    before those of ``i + 1``); each row gets its number inside its
    partition, and per-partition row counts - one row per partition,
    bounded by the partition count, not the data - give the offsets.
    """
    from pyspark.sql import Window
    by_part = df.orderBy(*order).withColumn("_pid", F.spark_partition_id())
    local = by_part.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1)
    sizes = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_size"))  # same sort, reused
    offsets = sizes.withColumn(
        "_offset", F.coalesce(F.sum("_size").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    offsets = offsets.select("_pid", "_offset")
    if parts <= 100_000:  # one row per partition: a known, small bound
        offsets = F.broadcast(offsets)
    return (local.join(offsets, "_pid")
            .withColumn(name, F.col("_offset") + F.col("_local"))
            .drop("_pid", "_local", "_offset"))


def string_index_table(df: DataFrame, col: str, name: str = "idx") -> DataFrame:
    """M1 as a table ``value, n, idx``: frequency descending, ties by value ascending.

    One row per distinct value, counted with map-side partial
    aggregation; the index is the row's position in the global order
    (``ranked``), so no task ever holds all distinct values.
    """
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("value").isNotNull())
    # the label table is read twice by the rank (rows and partition sizes):
    # write it once so the input is scanned once
    counts = reliable_checkpoint(counts)
    out = ranked(counts, [F.col("n").desc(), F.col("value")], name)
    return out.withColumn(name, F.col(name).cast("double")).select("value", "n", name)


def standard_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """M5 as columns: ``x / stddev_samp(x)`` (0.0 where the stddev is 0), one pass of moments."""
    sd = df.agg(F.struct(*[F.stddev_samp(F.col(c)).alias(c) for c in cols])).scalar()
    return df.withColumns({
        f"{c}{suffix}": F.when(sd[c] == 0, F.lit(0.0)).otherwise(F.col(c) / sd[c]) for c in cols})
