"""Exact interpolated quantiles without gathering a column (used by A3/A4, E15).

Spark's exact ``percentile`` aggregate keeps every distinct value of the
column in one final task, which does not survive a 100 TB column.  This
operator reads the table twice, for any number of columns and ranks at once:

1. one aggregate gives, per column, the count and a mergeable quantile sketch
   (``percentile_approx``, rank error at most ``n / ACCURACY``), asked a little below and a little
   above each wanted quantile: a bracket that holds the wanted ranks;
2. one grouped aggregate counts values: inside a bracket each distinct value by itself
   (a hot value is one row), between brackets all together.  The counts between
   brackets say exactly how many values lie below each bracket, so whether it holds its
   ranks; a bracket that does not (which the sketch's bound excludes but for rounding) is
   widened to the stretch that does, and counted again.

The distinct values of the brackets, some ``4 n / ACCURACY`` for each quantile, are dealt by
range; the sums of the ranges, one row each, tell in which range a rank lies, and a
running sum over that range alone finds it.  Comparisons only, no arithmetic on values:
any doubles work, infinities and both ends of the range included.  The result is linear
interpolation between the two closest ranks - the definition of Spark's ``percentile``
and of SQL ``quantile_cont``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evstat.session import reliable_checkpoint

ACCURACY = 10_000
MARGIN = 2 / ACCURACY
WHOLE = 20_000             # columns of up to so many values are one bracket: the margins may be narrower than a rank
_INF = float("inf")


def _is_number(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def head_columns(x: Column, i: int, probs: Sequence[float]) -> list[Column]:
    """Aggregates giving column ``i``'s count and sketch (to fold into another ``agg``)."""
    at = [min(1.0, max(0.0, p + d)) for p in probs for d in (-MARGIN, MARGIN)]
    number = F.when(_is_number(x), x)
    return [F.count(number).alias(f"_qn_{i}"), F.percentile_approx(number, at, ACCURACY).alias(f"_qs_{i}")]


def heads_from_row(row, n_cols: int) -> dict[int, dict]:
    """Counts and brackets from a row produced with ``head_columns``."""
    return {i: {"n": row[f"_qn_{i}"], "ends": list(zip(row[f"_qs_{i}"][::2], row[f"_qs_{i}"][1::2], strict=True))}
            for i in range(n_cols) if row[f"_qn_{i}"]}


def _merged(brackets: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Disjoint brackets in order."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _literal(v: float) -> Column:
    return F.lit(float(v)).cast("double")


def _counted(df: DataFrame, cols: Sequence[str], brackets: dict[int, list[tuple[float, float]]]) -> DataFrame:
    """``c, seg, v, n``: counts by stretch.  Stretch ``2 k + 1`` is bracket ``k`` of the column, with a row for each
    distinct value; ``2 k`` lies below it and has one row."""
    cells = []
    for c, own in brackets.items():
        x = F.col(cols[c]).cast("double")
        seg = None
        for k, (lo, hi) in enumerate(own):          # in order, so the first that holds decides
            below, inside = x < _literal(lo), x <= _literal(hi)
            seg = F.when(below, F.lit(2 * k)) if seg is None else seg.when(below, F.lit(2 * k))
            seg = seg.when(inside, F.lit(2 * k + 1))
        cells.append(F.struct(F.lit(c).alias("c"), F.when(_is_number(x), seg.otherwise(F.lit(2 * len(own)))).alias("seg"), x.alias("v")))
    stacked = df.select(F.inline(F.array(*cells))).where(F.col("seg").isNotNull())
    return (stacked.groupBy("c", "seg", F.when(F.col("seg") % 2 == 1, F.col("v")).alias("v"))
            .agg(F.count("*").alias("n")))


def select_ranks(df: DataFrame, cols: Sequence[str], wanted: dict[int, set[int]],
                 brackets: dict[int, list[tuple[float, float]]]) -> dict[tuple[int, int], float]:
    """Exact value at each 0-based rank: ``wanted = {column: ranks}``, looked for in ``brackets`` first."""
    out: dict[tuple[int, int], float] = {}
    brackets = {c: _merged(brackets[c]) for c, ranks in wanted.items() if ranks}
    while brackets:
        counts = reliable_checkpoint(_counted(df, cols, brackets))
        totals = {(r["c"], r["seg"]): r["n"] for r in counts.groupBy("c", "seg").agg(F.sum("n").alias("n")).collect()}
        targets, wider = [], {}
        for c, own in brackets.items():
            up = list(accumulate(totals.get((c, s), 0) for s in range(2 * len(own) + 1)))
            for r in sorted(wanted[c]):
                if not 0 <= r < up[-1]:
                    raise ValueError(f"rank {r} outside column {cols[c]}")
                seg = next(s for s, n in enumerate(up) if r < n)
                if seg % 2:
                    targets.append((c, seg, r, r - (up[seg - 1])))
                else:                               # between brackets: that stretch becomes one, its ends included
                    k = seg // 2
                    wider.setdefault(c, []).append((own[k - 1][1] if k else -_INF, own[k][0] if k < len(own) else _INF))
        out |= _located(counts, targets)
        wanted = {c: {r for r in wanted[c] if (c, r) not in out} for c in wider}
        brackets = {c: _merged(x) for c, x in wider.items()}
    return out


def _located(counts: DataFrame, targets: Sequence[tuple[int, int, int, int]]) -> dict[tuple[int, int], float]:
    """Values of ``(column, stretch, rank, rank within the stretch)``."""
    if not targets:
        return {}
    spark = counts.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = counts.where("seg % 2 = 1").repartitionByRange(parts, "c", "seg", "v").withColumn("part", F.spark_partition_id())
    ranged = reliable_checkpoint(ranged)
    sums: dict[tuple[int, int], list] = {}
    for r in ranged.groupBy("c", "seg", "part").agg(F.sum("n").alias("n")).collect():     # a row a range and stretch
        sums.setdefault((r["c"], r["seg"]), []).append((r["part"], r["n"]))
    places = []
    for c, seg, rank, off in targets:
        for part, n in sorted(sums[c, seg]):
            if off < n:
                places.append((c, seg, part, rank, off))
                break
            off -= n
    place = F.array(*[F.struct(*[F.lit(x).cast("long").alias(name) for x, name in zip(p, ("c2", "seg2", "part2", "rank", "off"), strict=True)])
                      for p in places])
    asked = spark.range(1).select(F.inline(place))                                        # a literal table, a row a target
    inside = F.col("c").eqNullSafe(F.col("c2")) & (F.col("seg") == F.col("seg2")) & (F.col("part") == F.col("part2"))
    near = ranged.join(F.broadcast(asked.select("c2", "seg2", "part2").distinct()), inside, "left_semi")
    run = Window.partitionBy("c", "seg", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = near.withColumn("up", F.sum("n").over(run))
    hit = up.join(F.broadcast(asked), inside & (F.col("up") - F.col("n") <= F.col("off")) & (F.col("off") < F.col("up")))
    return {(r["c"], r["rank"]): r["v"] for r in hit.select("c", "rank", "v").collect()}


def exact_quantiles_multi(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                          heads: dict[int, dict] | None = None) -> dict[str, list[float | None]]:
    """Interpolated exact quantiles of several columns (nulls and NaN ignored).

    ``heads`` (from ``head_columns`` folded into a caller's aggregate, for the same ``probs``)
    saves the first read.
    """
    for p in probs:
        if not 0.0 <= p <= 1.0:
            raise ValueError("probabilities must be in [0, 1]")
    if not probs:
        return {c: [] for c in cols}
    if heads is None:
        aggs = [a for i, c in enumerate(cols) for a in head_columns(F.col(c).cast("double"), i, probs)]
        heads = heads_from_row(df.agg(*aggs).first(), len(cols))
    wanted = {i: {k for p in probs for k in (math.floor(p * (h["n"] - 1)), math.ceil(p * (h["n"] - 1)))} for i, h in heads.items()}
    at = select_ranks(df, cols, wanted, {i: [(-_INF, _INF)] if h["n"] <= WHOLE else h["ends"] for i, h in heads.items()})
    res: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        n = heads.get(i, {}).get("n", 0)
        res[c] = [_between(at, i, p * (n - 1)) if n else None for p in probs]
    return res


def _between(at: dict[tuple[int, int], float], i: int, x: float) -> float:
    a, b, frac = at[i, math.floor(x)], at[i, math.ceil(x)], x - math.floor(x)
    if frac == 0 or a == b:
        return a
    return a + (b - a) * frac if math.isfinite(b - a) or not math.isfinite(a) or not math.isfinite(b) else a * (1 - frac) + b * frac


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float | None]:
    """Interpolated exact quantiles of one column."""
    return exact_quantiles_multi(df, [col], probs)[col]


def exact_quantiles_row(df: DataFrame, col: str, probs: Sequence[float],
                        names: Sequence[str]) -> DataFrame:
    """One-row DataFrame with the exact quantiles under ``names``."""
    vals = exact_quantiles(df, col, probs)
    return df.sparkSession.range(1).select(
        *[F.lit(v).cast("double").alias(nm) for v, nm in zip(vals, names)])
