"""Principal components from one pass of co-moments (M6).

Each task folds its rows into a count, the means and the matrix of co-moments about them, a block of
rows at a time; the pieces of the tasks are merged pairwise by

    M = M_a + M_b + (mean_b - mean_a)(mean_b - mean_a)' n_a n_b / (n_a + n_b)

so no large sums are subtracted from each other, as they are in ``sum(x y) - n mean(x) mean(y)``.
A piece is ``d`` rows of the matrix, merged row by row in two rounds (tasks of one remainder by
``FAN`` first): a merging task reads ``1 / FAN`` of the tasks' rows and holds two of them.  The
driver gets the merged ``d x d`` matrix, ``8 d^2`` bytes, which the number of columns bounds.

Every component has length 1 and its largest entry (by size, the first of equals) positive.  MLlib leaves
the sign open.  Components come by falling variance.

Cases: rows with a null or non-finite value in any of the columns take no part in the fit, and get null
scores; fewer than two rows raise ValueError, as there is no variance; with ``scale`` a constant column
counts as 0 throughout.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 256
PIECE = "i int, task int, n bigint, mean array<double>, m array<double>"


@dataclass(frozen=True)
class Components:
    """``weights[k]`` is component ``k`` over ``cols``; ``variances[k]`` its variance; ``scales`` what each column is
    divided by before; ``total`` the sum of all variances."""
    cols: tuple[str, ...]
    rows: int
    variances: np.ndarray
    weights: np.ndarray
    scales: np.ndarray
    total: float

    def table(self, spark: SparkSession) -> DataFrame:
        """``component, variance, share, col, weight``: a row a component and column."""
        share = self.variances / self.total if self.total else np.zeros(len(self.variances))
        return spark.createDataFrame(
            [(k, float(v), float(share[k]), c, float(self.weights[k, j]))
             for k, v in enumerate(self.variances) for j, c in enumerate(self.cols)],
            "component int, variance double, share double, col string, weight double")

    def scores(self, prefix: str = "pc") -> list[Column]:
        """The components of a row as built-in expressions, uncentred as in MLlib."""
        ok = _finite(self.cols)
        out = []
        for k, w in enumerate(self.weights):
            dot = sum((F.col(f"`{c}`").cast("double") * float(w[j] / self.scales[j]) for j, c in enumerate(self.cols)
                       if self.scales[j]), F.lit(0.0))
            out.append(F.when(ok, dot).alias(f"{prefix}{k}"))
        return out


def _finite(cols: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in cols:
        x = F.abs(F.col(f"`{c}`").cast("double"))
        ok = ok & F.coalesce(x < float("inf"), F.lit(False))      # NaN is above infinity in Spark's order
    return ok


def _merge(a, b):
    """Two pieces ``(n, mean, m)``; ``m`` may be the whole matrix or its row ``i`` (then ``mean[i]`` leads)."""
    (na, xa, ma), (nb, xb, mb) = a, b
    if not na:
        return b
    n, delta = na + nb, xb - xa
    return n, xa + delta * (nb / n), ma + mb + np.outer(delta, delta) * (na * (nb / n))


def _partial(d: int):
    def fold(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        state = 0, np.zeros(d), np.zeros((d, d))
        for block in blocks:
            x = block.to_numpy(dtype=float)
            if len(x):
                mean = x.mean(axis=0)
                state = _merge(state, (len(x), mean, (x - mean).T @ (x - mean)))
        if state[0]:
            n, mean, m = state
            task = TaskContext.get().partitionId()
            for i in range(d):      # a row at a time: a wide matrix is never copied whole
                yield pd.DataFrame({"i": [i], "task": [task], "n": [n], "mean": [mean], "m": [m[i]]})
    return fold


def _merge_rows(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces sorted by ``i, task``: merges each run of equal keys, holding one merged row."""
    key, n, mean, m = None, 0, None, None
    for block in blocks:
        for row in block.itertuples(index=False):
            x, r = np.asarray(row.mean), np.asarray(row.m)
            if key == (row.i, row.task):
                delta, total = x - mean, n + row.n
                m = m + r + delta[row.i] * delta * (n * (row.n / total))
                mean, n = mean + delta * (row.n / total), total
                continue
            if key is not None:
                yield pd.DataFrame({"i": [key[0]], "task": [key[1]], "n": [n], "mean": [mean], "m": [m]})
            key, n, mean, m = (row.i, row.task), row.n, x, r
    if key is not None:
        yield pd.DataFrame({"i": [key[0]], "task": [key[1]], "n": [n], "mean": [mean], "m": [m]})


def co_moments(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and co-moments (not yet divided by rows - 1) of ``cols``."""
    cols = list(cols)
    x = df.where(_finite(cols)).select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    pieces = x.mapInPandas(_partial(len(cols)), PIECE)
    for task in (F.col("task") % FAN, F.lit(0)):
        keyed = pieces.select("i", task.cast("int").alias("task"), "n", "mean", "m")
        pieces = keyed.repartition("i", "task").sortWithinPartitions("i", "task").mapInPandas(_merge_rows, PIECE)
    rows = {r["i"]: r for r in pieces.collect()}        # one a column
    if not rows:
        return 0, np.zeros(len(cols)), np.zeros((len(cols), len(cols)))
    return rows[0]["n"], np.array(rows[0]["mean"]), np.array([rows[i]["m"] for i in range(len(cols))])


def principal_components(df: DataFrame, cols: Sequence[str], k: int | None = None, scale: bool = False) -> Components:
    """The first ``k`` (all, if None) components of the covariance of ``cols``, or with ``scale`` of their correlation."""
    n, _, m = co_moments(df, cols)
    if n < 2:
        raise ValueError("principal components need two rows with values in all columns")
    cov = (m + m.T) / 2 / (n - 1)
    scales = np.sqrt(np.diag(cov)) if scale else np.ones(len(cov))
    safe = np.where(scales > 0, scales, 1)
    values, vectors = np.linalg.eigh(cov / safe[:, None] / safe[None, :])
    order = np.argsort(-values, kind="stable")
    values, weights = np.maximum(values[order], 0), vectors[:, order].T
    lead = np.argmax(np.round(np.abs(weights), 12), axis=1)
    weights = weights * np.where(weights[np.arange(len(weights)), lead] < 0, -1, 1)[:, None]
    k = len(values) if k is None else k
    return Components(tuple(cols), int(n), values[:k], weights[:k], scales, float(values.sum()))
