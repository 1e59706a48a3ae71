"""Grouped moments, shard summaries and table summaries.

All statistics of one call are computed in a single ``agg`` so Spark runs
one scan and one shuffle with map-side partial aggregation: a hot group
(a third of all rows) is collapsed to one partial row per input
partition before the exchange, so no reducer ever sees it whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evstat.functions.exprs import numeric_reading
from evstat.operators.quantiles import exact_quantiles_multi, head_columns, heads_from_row

_STATS = {
    "mean": F.avg,
    "count": F.count,
    "var_samp": F.var_samp,
    "stddev_samp": F.stddev_samp,
    "var_pop": F.var_pop,
    "stddev_pop": F.stddev_pop,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
}


def moments(cols: dict[str, Sequence[str]], names: dict[tuple[str, str], str] | None = None) -> list[Column]:
    """Aggregate columns for ``{column: [stat, ...]}``; default name ``{stat}_{column}``."""
    out = []
    for c, stats in cols.items():
        for s in stats:
            name = (names or {}).get((c, s), f"{s}_{c}")
            out.append(_STATS[s](F.col(c)).alias(name))
    return out


def grouped_moments(df: DataFrame, by: str | Sequence[str], cols: dict[str, Sequence[str]],
                    names: dict[tuple[str, str], str] | None = None,
                    count_name: str | None = "n") -> DataFrame:
    """A1: per group, the requested moments of each column.

    ``var_samp``/``stddev_samp`` give null for a one-row group,
    ``var_pop``/``stddev_pop`` give 0.0 (trap T12).
    """
    keys = [by] if isinstance(by, str) else list(by)
    aggs = ([F.count(F.lit(1)).alias(count_name)] if count_name else []) + moments(cols, names)
    return df.groupBy(*keys).agg(*aggs)


def shard_summary(df: DataFrame, key: str = "key", tone: str = "AvgTone",
                  scale: str = "GoldsteinScale") -> DataFrame:
    """A2: count, mean and population stddev of two columns per shard.

    Output columns follow the reference's summary file:
    ``_id, count, avg_tone, sd_tone, avg_scale, sd_scale``.
    """
    return df.groupBy(F.col(key).alias("_id")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(tone).alias("avg_tone"),
        F.stddev_pop(tone).alias("sd_tone"),
        F.avg(scale).alias("avg_scale"),
        F.stddev_pop(scale).alias("sd_scale"),
    )


def filtered_count(df: DataFrame, cond: Column | None = None, name: str = "n") -> DataFrame:
    """A5: global row count under a filter (one row)."""
    if cond is not None:
        df = df.where(cond)
    return df.agg(F.count(F.lit(1)).alias(name))


# ---------------------------------------------------------------- summaries (A3, A4)

SUMMARY_ALL = ("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")


def summary_approx(df: DataFrame, *stats: str) -> DataFrame:
    """A3/A4 as Spark prints them: ``df.summary`` (string cells, GK percentiles)."""
    return df.summary(*stats) if stats else df.summary()


def _numeric(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, T.NumericType):
        return F.col(c).cast("double")
    if isinstance(dt, T.BooleanType):
        return F.col(c).cast("int").cast("double")
    return numeric_reading(c)


def summary_exact(df: DataFrame, cols: Sequence[str] | None = None,
                  stats: Sequence[str] = SUMMARY_ALL) -> DataFrame:
    """A3/A4 with exact, interpolated percentiles and double cells.

    One row per statistic (column ``summary``), one double column per
    input column.  Text columns are read as numbers with ``try_cast``, so
    values that are not numbers are skipped instead of failing under ANSI
    (trap T16); ``count`` counts non-null cells as ``df.summary`` does.
    Moments come from one aggregate; each percentile from ``operators.quantiles``,
    one more read (no column is ever gathered).
    """
    cols = list(cols or df.columns)
    pct = {s: float(s.rstrip("%")) / 100.0 for s in stats if s.endswith("%")}
    aggs = []
    for i, c in enumerate(cols):
        x = _numeric(df, c)
        aggs += [F.count(F.col(c)).cast("double").alias(f"count_{i}"),
                 F.avg(x).alias(f"mean_{i}"),
                 F.stddev_samp(x).alias(f"stddev_{i}"),
                 F.min(x).alias(f"min_{i}"),
                 F.max(x).alias(f"max_{i}")]
        if pct:
            aggs += head_columns(x, i, list(pct.values()))  # sketches ride along: one read fewer
    head = df.agg(*aggs).first()
    qs: dict[str, list] = {}
    if pct:
        src = df.select(*[_numeric(df, c).alias(f"_x{i}") for i, c in enumerate(cols)])
        qs = exact_quantiles_multi(src, [f"_x{i}" for i in range(len(cols))], list(pct.values()),
                                   heads=heads_from_row(head, len(cols)))
    table: dict[str, list] = {s: [] for s in stats}
    for i, c in enumerate(cols):
        for s in stats:
            if s in pct:
                table[s].append(qs[f"_x{i}"][list(pct).index(s)])
            else:
                table[s].append(head[f"{s}_{i}"])
    schema = T.StructType([T.StructField("summary", T.StringType(), False)]
                          + [T.StructField(c, T.DoubleType(), True) for c in cols])
    rows = [[s] + [None if v is None else float(v) for v in table[s]] for s in stats]
    return df.sparkSession.createDataFrame(rows, schema)
