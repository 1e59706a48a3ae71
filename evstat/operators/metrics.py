"""Regression and classification metrics as plain aggregates.

Each metric family is one ``agg`` over a ``label, prediction`` table:
map-side partial sums, one small shuffle, no model object needed, so a
saved prediction table can be re-evaluated at any size (V15).  Results
equal MLlib's ``RegressionEvaluator`` / ``MulticlassClassificationEvaluator``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evstat.session import reliable_checkpoint


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction",
              name: str = "residual") -> DataFrame:
    """``label - prediction`` added to every row."""
    return df.withColumn(name, F.col(label) - F.col(prediction))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       num_features: int | None = None, fit_intercept: bool = True) -> DataFrame:
    """V1-V3, V14 in one row: ``n, rmse, mse, mae, r2, explained_variance[, dof]``.

    One pass, one aggregate (no subquery, so it also works on predictions
    of a model that Spark treats as non-deterministic).  The centred sums
    come from Spark's numerically stable moments:
    ``SST = n var_pop(y)``, ``SSR = n (var_pop(p) + (mean_p - mean_y)^2)``.
    Rows without a label or a prediction are not scored and not counted; ``r2``
    is null where the label is constant.
    """
    y = F.col(label).cast("double")
    p = F.col(prediction).cast("double")
    agg = df.where(y.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((p - y) * (p - y)).alias("sse"),
        F.sum(F.abs(p - y)).alias("sae"),
        F.var_pop(y).alias("vy"), F.var_pop(p).alias("vp"),
        F.avg(y).alias("my"), F.avg(p).alias("mp"),
    )
    ev = F.col("vp") + (F.col("mp") - F.col("my")) * (F.col("mp") - F.col("my"))
    cols = [
        F.col("n"),
        F.sqrt(F.try_divide("sse", "n")).alias("rmse"),
        F.try_divide("sse", "n").alias("mse"),
        F.try_divide("sae", "n").alias("mae"),
        (F.lit(1.0) - F.try_divide(F.col("sse"), F.col("vy") * F.col("n"))).alias("r2"),
        ev.alias("explained_variance"),
    ]
    if num_features is not None:
        cols.append((F.col("n") - F.lit(num_features) - F.lit(1 if fit_intercept else 0))
                    .alias("dof"))
    return agg.select(*cols)


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Confusion counts ``label, prediction, n`` (one shuffle, tiny output)."""
    return df.groupBy(F.col(label).cast("double").alias("label"),
                      F.col(prediction).cast("double").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def per_label_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V5-V9: per label ``tp, fp, fn, tn``, rates, precision, recall, F1.

    Labels are every value seen as a label or a prediction.  A label never
    predicted has precision 0.0, as in MLlib.  Rows without a label or a
    prediction are not scored.
    """
    # the confusion table (labels x predictions rows) is written once to the
    # checkpoint folder, so the rows are scanned once for all derived counts
    scored = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    c = reliable_checkpoint(confusion(scored, label, prediction))
    total = c.agg(F.sum("n")).scalar()
    as_label = c.groupBy(F.col("label").alias("cls")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    as_pred = c.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    m = as_label.join(as_pred, "cls", "full_outer").select(
        F.col("cls").alias("label"),
        F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"))
    tp, sup, pred = F.col("tp"), F.col("support"), F.col("predicted")
    fp = pred - tp
    fn = sup - tp
    tn = total - tp - fp - fn
    precision = F.coalesce(tp / F.nullif(pred, F.lit(0)), F.lit(0.0))
    recall = F.coalesce(tp / F.nullif(sup, F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(F.lit(2.0) * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    fpr = F.coalesce(fp / F.nullif(fp + tn, F.lit(0)), F.lit(0.0))
    return m.select(
        "label", "support", "tp", fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        fpr.alias("false_positive_rate"), recall.alias("true_positive_rate"),
        precision.alias("precision"), recall.alias("recall"), f1.alias("f_measure"))


def weighted_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V4, V10 of a scored table (``weighted_of_labels`` of its per-label table)."""
    return weighted_of_labels(per_label_metrics(df, label, prediction))


def weighted_of_labels(per: DataFrame) -> DataFrame:
    """Accuracy and label-share weighted FPR, TPR, F1, precision, recall.

    ``sum(share * m) = sum(support * m) / sum(support)``: one aggregate over
    the per-label table (one row per class), never over the rows.
    """
    sup = F.col("support")

    def wavg(c: str):
        return F.sum(sup * F.col(c)) / F.sum(sup)

    return per.agg(
        (F.sum("tp") / F.sum(sup)).alias("accuracy"),
        wavg("false_positive_rate").alias("weighted_false_positive_rate"),
        wavg("true_positive_rate").alias("weighted_true_positive_rate"),
        wavg("f_measure").alias("weighted_f_measure"),
        wavg("precision").alias("weighted_precision"),
        wavg("recall").alias("weighted_recall"),
    )


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V4: share of rows with ``prediction == label``."""
    return df.agg(F.avg(F.when(F.col(label).cast("double") == F.col(prediction).cast("double"), 1.0)
                        .otherwise(0.0)).alias("accuracy"))
