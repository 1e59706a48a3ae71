"""Binary logistic regression with elastic net on group-compressed rows (C1, T-4, V12).

Rows of categorical or binned features repeat few combinations, so one aggregate turns the
table into distinct combinations with the counts of both labels; the fit then reads only
those.  Each step is one aggregate over the combinations: loss, gradient and curvature
at the present weights, some ``d * d / 2`` sums for ``d`` features.  The driver minimises the
penalised quadratic model of that size (proximal Newton) and halves a step that does not
lower the objective.  It stops when the optimality (KKT) conditions hold.

The objective is MLlib's: mean log-loss plus ``reg * (net * |w|_1 + (1 - net) / 2 * |w|_2^2)``
on weights of features scaled by their sample standard deviation, the intercept free.

Cases: rows with a null or NaN feature or a label other than 0 and 1 take no part; a
constant feature gets the weight 0; rows of one label only have no finite intercept and raise;
no rows raise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evstat.session import reliable_checkpoint

TOLERANCE = 1e-9


@dataclass
class LogitModel:
    features: list[str]
    coefficients: np.ndarray
    intercept: float
    violation: float
    history: list[float] = field(default_factory=list)       # objective at the start and after every step

    def margin(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(self.features, self.coefficients, strict=True):
            out = out + F.col(c).cast("double") * F.lit(float(w))
        return out

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))

    def objective_table(self, spark: SparkSession) -> DataFrame:
        """``iteration, objective``."""
        return spark.createDataFrame(list(enumerate(map(float, self.history))), "iteration int, objective double")


def compress(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``x0, x1, ..., n, positive``: distinct combinations with their rows and those of label 1."""
    y = F.col(label).cast("double")
    xs = [F.col(c).cast("double") for c in features]
    known = y.isin(0.0, 1.0)
    for x in xs:
        known = known & x.isNotNull() & ~F.isnan(x)
    rows = df.where(known).select(*[x.alias(f"x{i}") for i, x in enumerate(xs)], y.alias("y"))
    return rows.groupBy(*[f"x{i}" for i in range(len(xs))]).agg(F.count("*").alias("n"), F.sum("y").alias("positive"))


def _soft_quadratic(h: np.ndarray, g: np.ndarray, at: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The minimum near ``at`` of ``g d + d h d / 2 + l1 |at + d|`` by coordinate descent."""
    w = at.copy()
    slope = g.copy()
    for _ in range(10_000):
        moved = 0.0
        for j in range(len(w)):
            if h[j, j] <= 0:
                continue
            pull = h[j, j] * w[j] - slope[j]
            new = np.sign(pull) * max(abs(pull) - l1[j], 0.0) / h[j, j]
            if new != w[j]:
                slope += h[:, j] * (new - w[j])
                moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < 1e-14:
            break
    return w


def fit(df: DataFrame, features: Sequence[str], label: str, *, reg: float = 0.3, net: float = 0.8) -> LogitModel:
    d = len(features)
    groups = reliable_checkpoint(compress(df, features, label))
    n = F.sum("n")
    # centred second moments: sums of squares about the mean lose no digits to a large mean
    means = groups.agg(n.alias("n"), F.sum("positive").alias("p"), *[(F.sum(F.col(f"x{i}") * F.col("n")) / n).alias(f"m{i}") for i in range(d)]).first()
    total, positive = means["n"] or 0, means["p"] or 0.0
    if not 0 < positive < total:
        raise ValueError("rows of both labels are needed")
    mean = np.array([means[f"m{i}"] for i in range(d)])
    about = groups.agg(*[F.sum((F.col(f"x{i}") - F.lit(float(mean[i]))) ** 2 * F.col("n")).alias(f"s{i}") for i in range(d)]).first()
    sd = np.sqrt(np.array([about[f"s{i}"] for i in range(d)]) / max(total - 1, 1))
    z = [(F.col(f"x{i}") - F.lit(float(mean[i]))) / F.lit(float(s)) if s > 0 else F.lit(0.0) for i, s in enumerate(sd)] + [F.lit(1.0)]
    l1, l2 = np.append(np.full(d, reg * net), 0.0), np.append(np.full(d, reg * (1 - net)), 0.0)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Objective, slope and curvature of its smooth part, from one aggregate over the combinations."""
        margin = sum((F.lit(float(w[i])) * z[i] for i in range(d)), F.lit(float(w[d])))
        loss = F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
        p = 1 / (1 + F.exp(-F.col("_m")))
        rows = groups.select("n", "positive", margin.alias("_m"), loss.alias("_l"), *[c.alias(f"z{i}") for i, c in enumerate(z)])
        sums = [F.sum(F.col("n") * F.col("_l") - F.col("positive") * F.col("_m"))]
        sums += [F.sum((F.col("n") * p - F.col("positive")) * F.col(f"z{i}")) for i in range(d + 1)]
        sums += [F.sum(F.col("n") * p * (1 - p) * F.col(f"z{i}") * F.col(f"z{j}")) for i in range(d + 1) for j in range(i, d + 1)]
        values = np.array(rows.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first(), dtype=float) / total
        h = np.zeros((d + 1, d + 1))
        h[np.triu_indices(d + 1)] = values[d + 2:]
        h = h + np.triu(h, 1).T + np.diag(l2)
        return values[0] + (l2 * w * w).sum() / 2 + (l1 * np.abs(w)).sum(), values[1:d + 2] + l2 * w, h

    def violation(w: np.ndarray, slope: np.ndarray) -> float:
        return float(np.where(w != 0, np.abs(slope + l1 * np.sign(w)), np.maximum(np.abs(slope) - l1, 0)).max())

    w = np.append(np.zeros(d), np.log(positive / (total - positive)))
    now, slope, h = at(w)
    history = [now]
    while violation(w, slope) > TOLERANCE:
        aim, share = _soft_quadratic(h, slope, w, l1), 1.0
        while True:
            tried = aim if share == 1.0 else w + share * (aim - w)
            then, slope2, h2 = at(tried)
            if then <= now or share < 1e-9:
                break
            share /= 2
        gain = now - then
        if gain < 0:
            break                            # rounding decides: no step lowers the objective
        w, now, slope, h = tried, then, slope2, h2
        history.append(now)
        if gain == 0:
            break
    coef = np.where(sd > 0, w[:d] / np.where(sd > 0, sd, 1), 0.0)
    return LogitModel(list(features), coef, float(w[d] - coef @ mean), violation(w, slope), history)
