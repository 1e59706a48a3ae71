"""Pearson chi-square independence tests.

At-scale route (no MLlib category limit, nothing gathered):

* all features are stacked into ``(feature, value)`` pairs in one scan
  and counted per ``(feature, value, label)`` - one shuffle with
  map-side partial aggregation, so a hot value costs one row per
  partition;
* for a cell with count ``o``, row total ``r``, label total ``c`` and grand
  total ``N`` the expected count is ``e = r c / N`` and the cell adds
  ``(o - e)^2 / e``; ``o N - r c`` is taken in whole numbers (decimal), so
  nothing cancels at 10^12 rows.  The empty cells of a value add up to
  ``r (N - sum of its observed c) / N``: they never have to be generated, so
  there is no cross product of values and labels;
* row and label totals stay tables, joined on the value and on the label
  (AQE sizes the joins), whatever the number of classes;
* ``dof = (values - 1) * (labels - 1)``; the p-value is the chi-square
  survival function, built from Spark built-ins and evaluated per feature
  (one row each) in a bounded number of steps.

``chi_square_mllib`` runs MLlib's ``ChiSquareTest`` on the same input as
a cross-check.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evstat.session import reliable_checkpoint


# ---------------------------------------------------------------- chi-square tail (built-ins only)

#: Stirling's series of ``log Gamma``: the factors of 1/z, 1/z^3, 1/z^5, ... (fixed values)
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
_SHIFT = 8
#: from this ``dof / 2`` on, the tail is integrated around its peak
_LARGE = 5000.0
_WIDTH = 12.0              # standard deviations; beyond them a double cannot tell the tail from 0 or 1
_SIMPSON = 4000            # even number of steps of the integration


def _stirling_rest(z: Column) -> Column:
    """``log Gamma(z) - ((z - 1/2) log z - z + log(2 pi)/2)`` for ``z`` of 8 or more."""
    z2 = z * z
    out = F.lit(0.0)
    for factor in reversed(_STIRLING):
        out = out / z2 + F.lit(factor)
    return out / z


def _log_gamma(a: Column) -> Column:
    """``log Gamma(a)`` for ``a > 0`` at constant cost."""
    z = a + F.lit(float(_SHIFT))
    below = F.log(a)
    for k in range(1, _SHIFT):
        below = below + F.log(a + F.lit(float(k)))
    return ((z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + _stirling_rest(z)) - below


_TINY = 1e-300


def _tail_of_large(a: Column, x: Column) -> Column:
    """``Q(a, x)`` for large ``a``: Simpson's rule over the density from ``x`` to
    12 standard deviations above the mean, all terms relative to ``a``."""
    top = a + F.lit(_WIDTH) * F.sqrt(a)
    h = (top - x) / F.lit(float(_SIMPSON))

    def density(k: Column) -> Column:
        u = (x + h * k - a) / a
        return F.exp(a * (F.log1p(u) - u) - F.log1p(u) - 0.5 * F.log(F.lit(2 * math.pi) * a) - _stirling_rest(a))

    weight = lambda k: F.when((k == 0) | (k == _SIMPSON), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(_SIMPSON)), F.lit(0.0),
                        lambda acc, k: acc + weight(k) * density(k.cast("double")))
    sd = F.sqrt(a)
    return (F.when(x >= top, F.lit(0.0)).when(x <= a - F.lit(_WIDTH) * sd, F.lit(1.0))
            .otherwise(F.least(total * h / 3.0, F.lit(1.0))))


def chi2_sf(stat: Column, dof: Column) -> Column:
    """P(X >= stat) for X ~ chi-square(dof), as ``1 - CDF`` (MLlib's definition).

    With ``a = dof/2``, ``x = stat/2`` and ``f = x^a e^-x / Gamma(a)``:
    for ``x < a + 1`` the CDF is ``f * sum_k x^k / (a (a+1) ... (a+k))`` (terms
    shrink from the first); otherwise the tail ``Q = f * CF`` comes from
    Lentz's continued fraction and ``1 - (1 - Q)`` is returned, as MLlib does.
    From ``a = 5000`` on the density is integrated instead.  All loops are
    ``aggregate`` over a ``sequence`` of at most 4,001 steps, whatever ``dof``
    and ``stat``; built-ins only, evaluated per feature (one row each).
    """
    a = dof.cast("double") / 2.0
    x = stat.cast("double") / 2.0
    log_f = a * F.log(x) - x - _log_gamma(a)
    near = F.least(a, F.lit(_LARGE))
    steps = F.ceil(F.lit(12.0) * F.sqrt(near + F.least(x, near + 1.0)) + F.lit(100.0)).cast("int")

    series = F.aggregate(
        F.sequence(F.lit(1), steps),
        F.struct((F.lit(1.0) / a).alias("t"), (F.lit(1.0) / a).alias("s")),
        lambda acc, k: F.struct((acc["t"] * x / (a + k)).alias("t"),
                                (acc["s"] + acc["t"] * x / (a + k)).alias("s")))
    cdf_series = F.least(F.exp(log_f) * series["s"], F.lit(1.0))

    b0 = x + 1.0 - a
    cf = F.aggregate(
        F.sequence(F.lit(1), steps),
        F.struct(b0.alias("b"), F.lit(1.0 / _TINY).alias("c"), (F.lit(1.0) / b0).alias("d"),
                 (F.lit(1.0) / b0).alias("h")),
        lambda acc, i: _lentz(acc, i.cast("double"), a))
    q = F.exp(log_f) * cf["h"]

    return (F.when(dof.isNull() | stat.isNull(), F.lit(None).cast("double"))
            .when(dof <= 0, F.lit(float("nan")))
            .when(stat <= 0, F.lit(1.0))
            .when(a >= F.lit(_LARGE), F.lit(1.0) - (F.lit(1.0) - _tail_of_large(a, x)))
            .when(x < a + 1.0, F.lit(1.0) - cdf_series)
            .otherwise(F.lit(1.0) - (F.lit(1.0) - q)))


def _lentz(acc, i, a):
    an = -i * (i - a)
    b = acc["b"] + 2.0
    d = an * acc["d"] + b
    d = F.when(F.abs(d) < _TINY, F.lit(_TINY)).otherwise(d)
    c = b + an / acc["c"]
    c = F.when(F.abs(c) < _TINY, F.lit(_TINY)).otherwise(c)
    d = F.lit(1.0) / d
    return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))


# ---------------------------------------------------------------- contingency

def _stack(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value"))
                      for f in features])
    return df.select(F.inline(pairs), F.col(label).alias("label"))


def contingency(df: DataFrame, features: Sequence[str] | str, label: str) -> DataFrame:
    """``feature, value, label, n`` - observed cells only."""
    features = [features] if isinstance(features, str) else list(features)
    return (_stack(df, features, label).groupBy("feature", "value", "label")
            .agg(F.count(F.lit(1)).alias("n")))


def distinct_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A10: number of distinct values (null counted as a value) per column.

    One scan; each column's distinct values are de-duplicated by a
    shuffle on ``(column, value)``, never gathered in one task.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for c in cols])
    return (df.select(F.inline(pairs)).groupBy("column", "value").agg(F.lit(1).alias("_one"))
            .groupBy("column").agg(F.count(F.lit(1)).alias("levels")))


# ---------------------------------------------------------------- the test (T-1..T-3)

def chi_square_of_cells(cells: DataFrame, with_p_value: bool = True) -> DataFrame:
    """The test from a table of observed cells ``feature, value, label, n`` (as ``contingency``
    gives it; every feature's cells add up to the same rows)."""
    by_label = cells.groupBy("feature", "label").agg(F.sum("n").alias("col_n"))
    by_value = cells.groupBy(F.col("feature").alias("_f"), F.col("value").alias("_v")).agg(F.sum("n").alias("row_n"))
    total = by_label.groupBy(F.col("feature").alias("_tf")).agg(
        F.sum("col_n").alias("total"), F.count(F.lit(1)).alias("labels"))
    full = (cells.join(by_label, ["feature", "label"])
            .join(by_value, (F.col("feature") == F.col("_f")) & F.col("value").eqNullSafe(F.col("_v")))
            .join(total, F.col("feature") == F.col("_tf")))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    num = lambda c: F.col(c).cast("double")
    off = (whole("n") * whole("total") - whole("row_n") * whole("col_n")).cast("double")
    per_value = full.groupBy("feature", "value").agg(
        F.sum(off / num("total") * off / num("row_n") / num("col_n")).alias("seen"),
        F.first("row_n").alias("row_n"), F.first("total").alias("total"), F.first("labels").alias("labels"),
        F.sum("col_n").alias("seen_n"))
    unseen = F.col("row_n").cast("double") * (F.col("total") - F.col("seen_n")) / F.col("total")
    per = per_value.groupBy("feature").agg(
        F.sum(F.col("seen") + unseen).alias("statistic"),
        ((F.count(F.lit(1)) - 1) * (F.first("labels") - 1)).alias("dof"))
    if with_p_value:
        per = per.withColumn("p_value", chi2_sf(F.col("statistic"), F.col("dof")))
    return per


def chi_square(df: DataFrame, features: Sequence[str] | str, label: str,
               with_p_value: bool = True) -> DataFrame:
    """Pearson chi-square of each feature against ``label``.

    Returns ``feature string, statistic double, dof bigint[, p_value double]``,
    one row per feature.  Null is a category of its own (MLlib's
    ``handleInvalid='keep'``).  Rows with a null label are ignored.
    """
    df = df.where(F.col(label).isNotNull())
    # one scan of the input: the observed cells (values x labels per feature) are
    # written to the checkpoint folder, all totals are sums over them
    return chi_square_of_cells(reliable_checkpoint(contingency(df, features, label)), with_p_value)


def chi_square_mllib(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Cross-check: MLlib ``ChiSquareTest`` on string-indexed features (flattened)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    idx = [StringIndexer(inputCol=f, outputCol=f"_{i}_idx", handleInvalid="keep")
           for i, f in enumerate(features)]
    lab = StringIndexer(inputCol=label, outputCol="_label_idx")
    asm = VectorAssembler(inputCols=[f"_{i}_idx" for i in range(len(features))],
                          outputCol="_features", handleInvalid="keep")
    src = df.select(*[F.col(f).cast("string").alias(f) for f in features],
                    F.col(label).cast("string").alias(label)).where(F.col(label).isNotNull())
    prepared = Pipeline(stages=idx + [lab, asm]).fit(src).transform(src)
    res = ChiSquareTest.test(prepared, "_features", "_label_idx", flatten=True)
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("featureIndex") + 1)
    return res.select(names.alias("feature"), F.col("statistic"),
                      F.col("degreesOfFreedom").alias("dof"), F.col("pValue").alias("p_value"))


# ---------------------------------------------------------------- report (T-4)

def association_report(df: DataFrame, features: Sequence[str], label: str,
                       max_iter: int = 10, reg_param: float = 0.3,
                       elastic_net: float = 0.8) -> dict[str, DataFrame]:
    """T-4: chi-square table, a logistic model on the indexed features and its metrics.

    Returns ``{"chi_square", "predictions", "by_label", "weighted", "objective"}``.
    """
    from evstat.operators import features as feat
    from evstat.operators import metrics, models

    chi = chi_square(df, features, label)
    pipe = feat.index_and_assemble(features, label, "features", "label_idx")
    lr = models.logistic_regression(max_iter=max_iter, reg_param=reg_param,
                                    elastic_net=elastic_net, features="features", label="label_idx")
    src = df.select(*[F.col(f).cast("string").alias(f) for f in features],
                    F.col(label).cast("string").alias(label)).where(F.col(label).isNotNull())
    model = models.fit_pipeline(pipe + [lr], src)
    pred = model.transform(src)
    lr_model = model.stages[-1]
    by_label = metrics.per_label_metrics(pred, "label_idx", "prediction")  # scores the rows once
    return {
        "chi_square": chi,
        "predictions": pred,
        "by_label": by_label,
        "weighted": metrics.weighted_of_labels(by_label),
        "objective": models.objective_history(df.sparkSession, lr_model),
    }
