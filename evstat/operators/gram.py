"""Elastic-net regression and its grid search from sufficient statistics.

A linear fit needs of the rows only their cross-moments: for every two features the sum of
products, with the constant 1 and the label as features of their own.  One grouped
aggregate gives them for every fold (and every hashed size) in a single read of the table;
the moments of a training part are the total less its held-out fold.  Each (size, fold)
is then solved in a task of its own for all points of the grid: a symmetric solve without
an L1 part; with one, some sweeps of coordinate descent and then exact active-set steps
on the standardised Gram matrix, until the optimality (KKT) conditions hold.  The held-out error also follows from moments, so a
search of 72 points and 5 folds reads the rows once and not 360 times.

The objective is MLlib's: label and features scaled by their population standard deviations,
``1/2 |y - Xw|^2 / n + reg/sd(y) * (net * |w|_1 + (1 - net)/2 * |w|_2^2)``, the intercept
free.  A feature that is constant on the training rows gets the coefficient 0.

Memory: a task holds the moments of the slots that occur, ``d`` of them: some
``60 * d ** 2`` bytes with its working copies, 1.5 GB for all of 5000 slots dense; the usual
sparse rows fill few pairs.  The shuffle holds one row for each fold and pair of slots that
occur together.  Precision: sums of squares lose digits where a mean is many
deviations from zero; shift such columns first.

Cases: rows with a null or NaN label, a null vector or a null fold take no part; zeros in
a vector are as absent ones; no rows give no fits.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONST, LABEL = -1, -2          # slots of the constant 1 and of the label
TOLERANCE = 1e-10              # of the optimality conditions, in standardised units
WARM_SWEEPS = 20               # of coordinate descent before exact active-set steps


def items(vector: str | Column) -> Column:
    """The non-zero entries of an ML vector as ``array<struct<i int, v double>>``."""
    u = F.unwrap_udt(vector)
    entry = lambda i, v: F.struct(i.cast("int").alias("i"), v.alias("v"))
    sparse = F.zip_with(u["indices"], u["values"], entry)
    dense = F.transform(u["values"], lambda v, i: entry(i, v))
    return F.filter(F.when(u["type"] == 0, sparse).otherwise(dense), lambda e: e["v"] != 0)


def cross_moments(rows: DataFrame, by: Sequence[str], entries: str = "items", label: str = "label") -> DataFrame:
    """``by, i, j, s`` with ``i <= j``: sums of products over the rows of each group."""
    y = F.col(label).cast("double")
    known = rows.where(y.isNotNull() & ~F.isnan(y) & F.col(entries).isNotNull())
    own = F.array(F.struct(F.lit(LABEL).alias("i"), y.alias("v")), F.struct(F.lit(CONST).alias("i"), F.lit(1.0).alias("v")))
    each = known.select(*by, F.concat(own, F.col(entries)).alias("_e"))
    pairs = each.select(*by, "_e", F.explode("_e").alias("_a")).select(*by, "_a", F.explode("_e").alias("_b"))
    return (pairs.where("_a.i <= _b.i").groupBy(*by, F.col("_a.i").alias("i"), F.col("_b.i").alias("j"))
            .agg(F.sum(F.col("_a.v") * F.col("_b.v")).alias("s")))


# ---------------------------------------------------------------- the solver

@dataclass
class Moments:
    """Dense moments of one part of the rows over the slots ``slots``."""

    n: float
    y: float
    yy: float
    x: np.ndarray
    xy: np.ndarray
    xx: np.ndarray

    @staticmethod
    def of(i: np.ndarray, j: np.ndarray, s: np.ndarray, slots: np.ndarray) -> Moments:
        d = len(slots)
        low = np.searchsorted(slots, i), np.searchsorted(slots, j)
        out = Moments(0.0, 0.0, 0.0, np.zeros(d), np.zeros(d), np.zeros((d, d)))
        pick = lambda a, b: s[(i == a) & (j == b)].sum()
        out.n, out.y, out.yy = pick(CONST, CONST), pick(LABEL, CONST), pick(LABEL, LABEL)
        for to, name in ((out.x, CONST), (out.xy, LABEL)):
            at = (i == name) & (j >= 0)
            to[low[1][at]] = s[at]
        both = i >= 0
        out.xx[low[0][both], low[1][both]] = s[both]
        out.xx[low[1][both], low[0][both]] = s[both]
        return out

    def squared_error(self, coef: np.ndarray, intercept: float) -> float:
        fit = coef @ self.xy + intercept * self.y
        return self.yy - 2 * fit + coef @ self.xx @ coef + 2 * intercept * (coef @ self.x) + intercept ** 2 * self.n


class Fit:
    """The standardised problem of one training part, solved for any regularisation."""

    def __init__(self, m: Moments, intercept: bool):
        self.m, self.intercept = m, intercept
        self.mean, self.mean_y = m.x / m.n, m.y / m.n
        square = np.diag(m.xx) / m.n
        var = square - self.mean ** 2
        self.sd = np.sqrt(np.where(var > 1e-13 * square, var, 0))
        var_y = m.yy / m.n - self.mean_y ** 2
        self.sd_y = float(np.sqrt(var_y)) if var_y > 1e-13 * m.yy / m.n else 0.0 if intercept else abs(self.mean_y)
        scale = np.where(self.sd > 0, self.sd, np.inf)
        shift = 1.0 if intercept else 0.0
        self.gram = (m.xx / m.n - shift * np.outer(self.mean, self.mean)) / np.outer(scale, scale)
        self.cross = (m.xy / m.n - shift * self.mean * self.mean_y) / (scale * (self.sd_y or 1.0))

    def penalties(self, reg: float, net: float) -> tuple[float, float]:
        return net * reg / self.sd_y, (1 - net) * reg / self.sd_y

    def violation(self, w: np.ndarray, l1: float, l2: float) -> float:
        """By how much the optimality conditions fail (0: ``w`` is the minimum)."""
        slope = self.gram @ w + l2 * w - self.cross
        return float(np.where(w != 0, np.abs(slope + l1 * np.sign(w)), np.maximum(np.abs(slope) - l1, 0)).max(initial=0.0))

    def weights(self, l1: float, l2: float, start: np.ndarray) -> np.ndarray:
        if l1 == 0:
            value, vector = np.linalg.eigh(self.gram + l2 * np.eye(len(self.cross)))
            usable = value > 1e-10 * max(value.max(initial=0.0), 1e-300)      # the least solution where many are best
            return (vector[:, usable] / value[usable]) @ (vector[:, usable].T @ self.cross)
        w = start.copy()
        free = np.flatnonzero(self.sd > 0)
        own = np.diag(self.gram)
        for _ in range(WARM_SWEEPS):
            slope = self.gram @ w - self.cross
            for j in free:
                pull = own[j] * w[j] - slope[j]
                new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (own[j] + l2)
                if new != w[j]:
                    slope += self.gram[j] * (new - w[j])
                    w[j] = new
            if self.violation(w, l1, l2) <= TOLERANCE:
                return w
        return self._active_set(w, l1, l2)

    def _active_set(self, w: np.ndarray, l1: float, l2: float) -> np.ndarray:
        """From ``w`` to the minimum by exact steps: with the signs of the non-zero weights held, the
        problem is linear; a step ends at its solution or where the first weight reaches 0.
        Collinear columns (as all levels of a category beside an intercept) make it singular: along
        its null space only the L1 part changes, so such a step always ends at a 0."""
        sign, stalled, best = np.sign(w), 0, np.inf
        while stalled <= 2 * len(w) + 2:
            slope = self.gram @ w + l2 * w - self.cross
            on = np.flatnonzero(sign)
            if not len(on) or np.abs(slope[on] + l1 * sign[on]).max() <= TOLERANCE:
                over = np.where(sign == 0, np.abs(slope) - l1, 0) * (self.sd > 0)
                j = int(np.argmax(over))
                if over[j] <= TOLERANCE:
                    return w
                sign[j] = -np.sign(slope[j])
                on = np.flatnonzero(sign)
            force = -(slope[on] + l1 * sign[on])
            value, vector = np.linalg.eigh(self.gram[np.ix_(on, on)] + l2 * np.eye(len(on)))
            along = vector.T @ force
            firm = value > 1e-11 * max(value.max(), 1e-300)
            loose = vector[:, ~firm] @ along[~firm]
            whole = np.abs(loose).max(initial=0.0) <= TOLERANCE
            step = vector[:, firm] @ (along[firm] / value[firm]) if whole else loose
            back = step * sign[on] < 0                      # weights that go towards 0
            reach = np.where(back, w[on] / np.where(back, -step, 1), np.inf)
            k = int(np.argmin(reach))
            if whole and reach[k] >= 1:
                w[on] += step
            elif np.isfinite(reach[k]):
                w[on] += reach[k] * step
                w[on[k]], sign[on[k]] = 0.0, 0.0
            else:
                break
            loss = w @ (0.5 * (self.gram @ w + l2 * w) - self.cross) + l1 * np.abs(w).sum()
            stalled, best = (0, loss) if loss < best else (stalled + 1, best)
        return w

    def solve(self, reg: float, net: float, start: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray, float]:
        """``coefficients, intercept, standardised weights, violation``."""
        w, bad = np.zeros(len(self.cross)), 0.0
        if self.sd_y > 0:
            l1, l2 = self.penalties(reg, net)
            w = self.weights(l1, l2, w if start is None else start)
            bad = self.violation(w, l1, l2)
        coef = np.where(self.sd > 0, w * self.sd_y / np.where(self.sd > 0, self.sd, 1), 0.0)
        return coef, self.mean_y - coef @ self.mean if self.intercept else 0.0, w, bad


# ---------------------------------------------------------------- one fit

_TERMS = "slot int, coefficient double, violation double"


def fit_table(rows: DataFrame, entries: str = "items", label: str = "label", *, reg: float = 0.3, net: float = 0.8,
              intercept: bool = True) -> DataFrame:
    """``slot, coefficient, violation`` for every slot that occurs, and slot -1 for the intercept."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, s = (pdf[c].to_numpy() for c in ("i", "j", "s"))
        slots = np.unique(i[i >= 0])
        coef, free, _, bad = Fit(Moments.of(i, j, s, slots), intercept).solve(reg, net)
        return pd.DataFrame({"slot": np.append(slots, CONST), "coefficient": np.append(coef, free), "violation": bad})

    whole = rows.select(F.lit(0).alias("part"), F.col(entries).alias("items"), F.col(label).alias("label"))
    return cross_moments(whole, ["part"]).groupBy("part").applyInPandas(solve, _TERMS)


def predict(entries: str | Column, table: DataFrame) -> Column:
    """Predictions of a fitted table, which has as many rows as the vector has slots; slots it lacks count 0."""
    found = {r["slot"]: r["coefficient"] for r in table.collect()}
    dense = [found.get(i, 0.0) for i in range(max(found, default=-1) + 1)]
    coef = F.from_json(F.lit(json.dumps(dense)), "array<double>")          # folded to one constant
    free = F.lit(float(found.get(CONST, 0.0)))
    return F.aggregate(entries, free, lambda acc, e: acc + e["v"] * F.coalesce(F.get(coef, e["i"]), F.lit(0.0)))


# ---------------------------------------------------------------- grid search

_FITS = "num_features int, fold int, point int, reg_param double, fit_intercept boolean, elastic_net double, n double, rmse double, violation double"


def search(rows: DataFrame, vectors: dict[int, str], label: str, fold: str, reg_params: Sequence[float],
           fit_intercepts: Sequence[bool], elastic_nets: Sequence[float]) -> DataFrame:
    """One row for each point of the grid and fold: the held-out ``rmse`` and the fit's KKT ``violation``.

    ``vectors`` names an ML vector column for each number of features; ``fold`` is a whole number.
    """
    stacked = F.array(*[F.struct(F.lit(int(k)).alias("num_features"), items(c).alias("items")) for k, c in vectors.items()])
    each = rows.where(F.col(fold).isNotNull()).select(F.col(fold).cast("int").alias("fold"), F.col(label).alias("label"), F.inline(stacked))
    by = ["num_features", "i", "j"]
    held = cross_moments(each, ["num_features", "fold"])
    folds = held.groupBy(*by).agg(F.sum("s").alias("total"), F.map_from_entries(F.collect_list(F.struct("fold", "s"))).alias("in"))
    names = rows.where(F.col(fold).isNotNull()).select(F.col(fold).cast("int").alias("fold")).distinct()
    every = F.sort_array(names.agg(F.collect_set("fold")).scalar())          # as many as there are folds
    parts = folds.withColumn("fold", F.explode(every)).select(
        *by, "fold", "total", F.coalesce(F.element_at("in", F.col("fold")), F.lit(0.0)).alias("held"))
    grid = [(r, f, a) for r in reg_params for f in fit_intercepts for a in elastic_nets]

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, total, out = (pdf[c].to_numpy() for c in ("i", "j", "total", "held"))
        slots = np.unique(i[i >= 0])
        train, test = Moments.of(i, j, total - out, slots), Moments.of(i, j, out, slots)
        if train.n < 0.5 or test.n < 0.5:
            return pd.DataFrame(columns=[c.split()[0] for c in _FITS.split(", ")])
        fits = {f: Fit(train, f) for f in set(fit_intercepts)}
        rows, start = [], {}
        for p, (r, f, a) in enumerate(grid):
            coef, free, start[f, a], bad = fits[f].solve(r, a, start.get((f, a)))
            rmse = np.sqrt(max(test.squared_error(coef, free), 0.0) / test.n)
            rows.append((key[0], key[1], p, float(r), bool(f), float(a), test.n, rmse, bad))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _FITS.split(", ")])

    return parts.groupBy("num_features", "fold").applyInPandas(solve, _FITS)


def ranked(fits: DataFrame) -> DataFrame:
    """The grid's points by average error over the folds, best first."""
    point = ["reg_param", "fit_intercept", "elastic_net", "num_features"]
    table = fits.groupBy(*point, "point").agg(F.avg("rmse").alias("avg_metric"))
    order = Window.orderBy("avg_metric", "point", "num_features")            # as many rows as the grid has points
    return table.select(F.row_number().over(order).alias("rank"), *point, "avg_metric")
