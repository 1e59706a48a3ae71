"""Parameter grids and cross-validated search.

The grid is driver-sized (one map per point), never data-sized.  Each
fit is a distributed MLlib job; ``parallelism`` runs several grid points
at once.  The training frame is persisted for the duration of the
search and released afterwards (the reference re-reads it for every
fit).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession

from evstat.operators import features as feat
from evstat.operators import models

# The reference's search space (4 x 2 x 3 x 3 = 72 points),
# 5 folds, 3 fits in parallel, 0.8 train ratio for the split variant.
GRID_REG_PARAM = [0.0, 0.1, 0.3, 0.5]
GRID_FIT_INTERCEPT = [True, False]
GRID_ELASTIC_NET = [0.0, 0.5, 1.0]
GRID_NUM_FEATURES = [1000, 3000, 5000]
NUM_FOLDS = 5
PARALLELISM = 3
TRAIN_RATIO = 0.8


def hashed_regression(cols: Sequence[str], label: str, num_features: int = 1000,
                      max_iter: int = models.REG_MAX_ITER) -> tuple[Pipeline, FeatureHasher, LinearRegression]:
    """``FeatureHasher`` + ``LinearRegression`` pipeline and its two stages."""
    h = feat.hasher(cols, "features", num_features)
    lr = LinearRegression(featuresCol="features", labelCol=label, maxIter=max_iter)
    return Pipeline(stages=[h, lr]), h, lr


def param_grid(h: FeatureHasher, lr: LinearRegression,
               reg_params: Sequence[float] = GRID_REG_PARAM,
               fit_intercepts: Sequence[bool] = GRID_FIT_INTERCEPT,
               elastic_nets: Sequence[float] = GRID_ELASTIC_NET,
               num_features: Sequence[int] = GRID_NUM_FEATURES) -> list:
    """G1: the grid of parameter maps (72 points with the defaults)."""
    return (ParamGridBuilder()
            .addGrid(lr.regParam, list(reg_params))
            .addGrid(lr.fitIntercept, list(fit_intercepts))
            .addGrid(lr.elasticNetParam, list(elastic_nets))
            .addGrid(h.numFeatures, list(num_features))
            .build())


def cross_validate(pipeline: Pipeline, grid: list, train: DataFrame, label: str,
                   folds: int = NUM_FOLDS, parallelism: int = PARALLELISM, seed: int = 42,
                   metric: str = "rmse", fold_col: str | None = None):
    """K-fold cross-validation; the evaluator scores the label the model trains on
    (trap T7).  ``fold_col`` gives user-defined folds (e.g. a shard column)."""
    ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=metric)
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=ev,
                        numFolds=folds, parallelism=parallelism, seed=seed)
    if fold_col:
        cv.setFoldCol(fold_col)
    train = models.training_frame(train)
    try:
        return cv.fit(train)
    finally:
        train.unpersist()


def train_validation_split(pipeline: Pipeline, grid: list, train: DataFrame, label: str,
                           ratio: float = TRAIN_RATIO, parallelism: int = 2, seed: int = 42,
                           metric: str = "rmse"):
    """Optional extra: one train / validation split instead of k folds."""
    ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=metric)
    tvs = TrainValidationSplit(estimator=pipeline, estimatorParamMaps=grid, evaluator=ev,
                               trainRatio=ratio, parallelism=parallelism, seed=seed)
    return tvs.fit(train)


def grid_table(spark: SparkSession, cv_model) -> DataFrame:
    """One row per grid point with its parameters and average metric, ranked.

    Columns: ``rank, reg_param, fit_intercept, elastic_net, num_features, avg_metric``.
    Grid-sized (72 rows by default), built on the driver from the model.
    """
    larger_better = cv_model.getEvaluator().isLargerBetter()
    rows = []
    for pm, metric in zip(cv_model.getEstimatorParamMaps(), cv_model.avgMetrics):
        vals = {p.name: v for p, v in pm.items()}
        rows.append((float(vals.get("regParam", float("nan"))), bool(vals.get("fitIntercept", True)),
                     float(vals.get("elasticNetParam", float("nan"))),
                     int(vals.get("numFeatures", -1)), float(metric)))
    rows.sort(key=lambda r: -r[4] if larger_better else r[4])
    return spark.createDataFrame(
        [(i + 1,) + r for i, r in enumerate(rows)],
        "rank int, reg_param double, fit_intercept boolean, elastic_net double, "
        "num_features int, avg_metric double")


def best_params(cv_model) -> dict:
    """Parameters of the best pipeline's stages, by name."""
    out = {}
    for stage in cv_model.bestModel.stages:
        for p, v in stage.extractParamMap().items():
            if p.name in ("regParam", "fitIntercept", "elasticNetParam", "numFeatures", "maxIter"):
                out[p.name] = v
    return out
