"""Models: closed-form elastic net, MLlib estimators, scoring, save / load
(SURVEY R1-R5, C1-C4, K1, S10-S12, V12, V13).

MLlib fits are distributed (per-partition gradient / statistics
aggregates with a tree reduce); the constructors below only fix the
reference's parameters as defaults.  The one-feature elastic net (R1,
R3) is also given in closed form as a single Spark aggregate, which an
SQL engine can reproduce exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LogisticRegression, MultilayerPerceptronClassifier,
                                       NaiveBayes, RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The reference's model settings.
REG_MAX_ITER = 10
REG_PARAM = 0.3
ELASTIC_NET = 0.8
FOREST_TREES = 6
MLP_LAYERS = [5, 10, 5, 2]
MLP_BLOCK = 128
MLP_SEED = 1234
MLP_MAX_ITER = 100


# ---------------------------------------------------------------- closed form

def elastic_net_1d(df: DataFrame, x: str, y: str, reg_param: float = REG_PARAM,
                   elastic_net: float = ELASTIC_NET) -> DataFrame:
    """One-feature linear regression with elastic net, standardised, with intercept.

    With population stddevs ``sx, sy``, correlation ``r``, ``e = reg/sy``:
    ``w = sign(r) * max(|r| - alpha*e, 0) / (1 + (1 - alpha)*e)``,
    ``coefficient = w * sy / sx``, ``intercept = mean(y) - coefficient * mean(x)``.
    This is the exact optimum of MLlib's objective for one feature, from
    one aggregate (map-side partial moments, one tiny shuffle).
    Returns ``n, coefficient, intercept``.
    """
    xx = F.col(x).cast("double")
    yy = F.col(y).cast("double")
    m = df.where(xx.isNotNull() & yy.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(xx).alias("mx"), F.avg(yy).alias("my"),
        F.stddev_pop(xx).alias("sx"), F.stddev_pop(yy).alias("sy"), F.corr(xx, yy).alias("r"))
    e = F.lit(float(reg_param)) / F.col("sy")
    a = F.lit(float(elastic_net))
    w = (F.signum(F.col("r")) * F.greatest(F.abs(F.col("r")) - a * e, F.lit(0.0))
         / (F.lit(1.0) + (F.lit(1.0) - a) * e))
    coef = F.when((F.col("sx") == 0) | (F.col("sy") == 0) | F.col("r").isNull(), F.lit(0.0)) \
        .otherwise(w * F.col("sy") / F.col("sx"))
    return m.select("n", coef.alias("coefficient"), "mx", "my").select(
        "n", "coefficient", (F.col("my") - F.col("coefficient") * F.col("mx")).alias("intercept"))


# ---------------------------------------------------------------- MLlib estimators

def linear_regression(features: str = "features", label: str = "label",
                      max_iter: int = REG_MAX_ITER, reg_param: float = REG_PARAM,
                      elastic_net: float = ELASTIC_NET, fit_intercept: bool = True) -> LinearRegression:
    """MLlib linear regression with the reference's defaults."""
    return LinearRegression(featuresCol=features, labelCol=label, maxIter=max_iter,
                            regParam=reg_param, elasticNetParam=elastic_net,
                            fitIntercept=fit_intercept)


def logistic_regression(features: str = "features", label: str = "label",
                        max_iter: int = REG_MAX_ITER, reg_param: float = REG_PARAM,
                        elastic_net: float = ELASTIC_NET) -> LogisticRegression:
    """Logistic regression (binomial or multinomial by label count)."""
    return LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter,
                              regParam=reg_param, elasticNetParam=elastic_net)


def naive_bayes(features: str = "features", label: str = "label") -> NaiveBayes:
    """Multinomial naive Bayes (features must be non-negative, see ``check_nonnegative``)."""
    return NaiveBayes(featuresCol=features, labelCol=label)


def random_forest(features: str = "features", label: str = "label", num_trees: int = FOREST_TREES,
                  seed: int = 42) -> RandomForestClassifier:
    """Random forest classifier (seeded)."""
    return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=num_trees, seed=seed)


def perceptron(features: str = "features", label: str = "label",
               layers: Sequence[int] = MLP_LAYERS, block_size: int = MLP_BLOCK,
               seed: int = MLP_SEED, max_iter: int = MLP_MAX_ITER) -> MultilayerPerceptronClassifier:
    """C4: multilayer perceptron, layers 5-10-5-2 by default."""
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=list(layers),
                                          blockSize=block_size, seed=seed, maxIter=max_iter)


# ---------------------------------------------------------------- input checks

def valid_class_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Keep rows whose label is a non-negative whole number (MLlib rejects others)."""
    y = F.col(label).cast("double")
    return df.where(y.isNotNull() & (y >= 0) & (y == F.floor(y)))


def check_class_labels(df: DataFrame, label: str = "label") -> None:
    """Raise if any label is negative, fractional or null."""
    y = F.col(label).cast("double")
    bad = df.where(y.isNull() | (y < 0) | (y != F.floor(y))).limit(1).count()
    if bad:
        raise ValueError(f"labels in {label!r} must be non-negative whole numbers")


def check_nonnegative(df: DataFrame, features: str = "features") -> None:
    """Raise if any feature value is negative (naive Bayes needs counts)."""
    bad = df.where(F.array_min(vector_to_array(F.col(features))) < 0).limit(1).count()
    if bad:
        raise ValueError(f"features in {features!r} must be non-negative")


def label_values(df: DataFrame, label: str = "label") -> list:
    """Sorted distinct labels of a training frame: one value per class, of which the
    fitted model keeps a row of weights on the driver anyway."""
    rows = (df.select(F.col(label).cast("double").alias("l")).where(F.col("l").isNotNull())
            .distinct().collect())
    return sorted(r["l"] for r in rows)


def prediction_to_label(prediction: str, labels: Sequence[float]):
    """Trap T23: MLlib naive Bayes predicts the *index* of the class among the
    sorted distinct training labels, not the label value (labels 1..5 come
    back as 0..4).  Map the index back to the label value."""
    arr = F.array(*[F.lit(float(v)) for v in labels])
    return F.element_at(arr, F.col(prediction).cast("int") + 1)


# ---------------------------------------------------------------- scoring and reports

def score(model, df: DataFrame) -> DataFrame:
    """K1: score a table with a fitted or loaded model (map-only)."""
    return model.transform(df)


def objective_history(spark: SparkSession, model) -> DataFrame:
    """``iteration, objective`` of a fitted model's training summary."""
    hist = list(model.summary.objectiveHistory)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(hist)],
                                 "iteration int, objective double")


def coefficients_table(spark: SparkSession, model) -> DataFrame:
    """``index, coefficient`` plus a row ``-1`` for the intercept and the iteration count."""
    coefs = model.coefficients.toArray().tolist()
    iters = int(model.summary.totalIterations) if model.hasSummary else None
    rows = [(i, float(c), iters) for i, c in enumerate(coefs)] + [(-1, float(model.intercept), iters)]
    return spark.createDataFrame(rows, "index int, coefficient double, iterations int")


# ---------------------------------------------------------------- persistence

def save(obj, path: str) -> None:
    """Save a fitted model, pipeline or an unfitted estimator, overwriting."""
    obj.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_best_of_cv(path: str) -> PipelineModel:
    """Load a saved cross-validation model and return its best pipeline."""
    return CrossValidatorModel.load(path).bestModel


def training_frame(df: DataFrame, partitions: int | None = None, key: Sequence[str] = (),
                   keep: Sequence[str] | None = None) -> DataFrame:
    """Frame for an iterative fit, persisted (memory, spilling to disk) so passes do
    not re-read the source; a lost executor's blocks are recomputed from lineage.

    The input's layout is left alone, whatever its size and the cluster's,
    unless ``partitions`` and ``key`` name one: then rows go to that many
    partitions by the hash of ``key`` and are sorted by all sortable columns
    inside, so seeded fits see the same rows in the same order everywhere.
    ``keep``: the columns that the stages read; the others only order the rows.
    """
    if partitions:
        order = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("udt", "map", "variant")]
        df = df.repartition(partitions, *(key or order)).sortWithinPartitions(*order)
    if keep is not None:
        df = df.select(*keep)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def fit_pipeline(stages: Sequence, df: DataFrame, partitions: int | None = None,
                 key: Sequence[str] = (), keep: Sequence[str] | None = None) -> PipelineModel:
    """M8: fit all stages in order on a persisted training frame (``training_frame``
    explains ``partitions``, ``key`` and ``keep``).

    The raw columns are persisted, not the assembled vectors: cached
    vector columns are deserialised on every pass, which measured slower
    than re-running the cheap feature transforms from cached columns.
    """
    train = training_frame(df, partitions, key, keep)
    try:
        return Pipeline(stages=list(stages)).fit(train)
    finally:
        train.unpersist()
