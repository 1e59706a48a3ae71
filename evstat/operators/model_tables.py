"""Fitted models as tables, scored by built-in expressions.

A forest becomes a table of nodes, every other classifier or regression a
table of weights.  Both are ordinary DataFrames: they are written and read
by any sink of ``sources``, joined, compared and queried, and outlive the
library version that fitted them.  ``scorer`` turns such a table into
column expressions over an array of features, so scoring is a map-only
projection without MLlib.

Sizes: a table has a row for each node or weight of a model that the fit
already keeps on the driver; only this table is collected, never rows of data.

Cases: a null feature array, or a null in it that the model reads, scores
null; NaN goes right in a tree, as in MLlib; equal scores give the smallest
class; an empty table raises.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import (LogisticRegressionModel, MultilayerPerceptronClassificationModel, NaiveBayesModel,
                                       RandomForestClassificationModel)
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = ("tree int, node int, feature int, threshold double, left_set array<double>, categories int, "
         "left int, right int, votes array<double>")
WEIGHTS = "kind string, layer int, out int, slot int, weight double"
WRITTEN_OUT = 2000  # terms of a model up to which its sums are plain arithmetic; longer ones are folds
INTERCEPT = -1      # the slot of a bias, prior or intercept


# ---------------------------------------------------------------- export

def forest_nodes(spark: SparkSession, model: RandomForestClassificationModel, path: str) -> DataFrame:
    """The nodes of a forest: the model is saved under ``path`` and its node table read, as Spark keeps it.

    ``feature`` is -1 in a leaf; ``votes`` are the shares of the classes there.  A numeric
    split sends ``value <= threshold`` left, a categorical one the values of ``left_set``.
    """
    model.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path.rstrip('/')}/data").select("treeID", "nodeData.*")
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    numeric = F.col("split.numCategories") < 0
    cut = F.col("split.leftCategoriesOrThreshold")
    leaf = F.col("leftChild") < 0
    return saved.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"),
        F.when(leaf, -1).otherwise(F.col("split.featureIndex")).alias("feature"),
        F.when(~leaf & numeric, F.get(cut, F.lit(0))).alias("threshold"),
        F.when(~leaf & ~numeric, cut).alias("left_set"),
        F.when(~leaf & ~numeric, F.col("split.numCategories")).alias("categories"),
        F.when(~leaf, F.col("leftChild")).alias("left"), F.when(~leaf, F.col("rightChild")).alias("right"),
        F.when(leaf, F.transform("impurityStats", lambda x: F.when(total == 0, F.lit(0.0)).otherwise(x / total))).alias("votes"))


def _rows(kind: str, layer: int, matrix, bias) -> list[tuple]:
    return [(kind, layer, o, s, float(w)) for o, line in enumerate(matrix) for s, w in [(INTERCEPT, bias[o]), *enumerate(line)]]


def weight_table(spark: SparkSession, model) -> DataFrame:
    """``kind, layer, out, slot, weight`` of a perceptron, multinomial naive Bayes, logistic or linear model."""
    if isinstance(model, MultilayerPerceptronClassificationModel):
        sizes, flat, rows, at = list(model.getLayers()), model.weights.toArray(), [], 0
        for k, (n_in, n_out) in enumerate(zip(sizes, sizes[1:])):
            matrix = flat[at:at + n_in * n_out].reshape(n_in, n_out).T
            at += n_in * n_out
            rows += _rows("perceptron", k, matrix, flat[at:at + n_out])
            at += n_out
    elif isinstance(model, NaiveBayesModel):
        if model.getModelType() != "multinomial":
            raise ValueError(f"naive Bayes of type {model.getModelType()!r} has no weight table")
        rows = _rows("bayes", 0, model.theta.toArray(), model.pi.toArray())
    elif isinstance(model, LogisticRegressionModel):
        matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        if len(bias) == 1:      # two classes by one margin: class 1 where it exceeds the threshold's
            t = model.getThreshold()
            edge = math.log(t / (1 - t)) if 0 < t < 1 else (math.inf if t >= 1 else -math.inf)
            matrix, bias = [[0.0] * matrix.shape[1], matrix[0]], [edge, bias[0]]
        rows = _rows("logistic", 0, matrix, bias)
    elif isinstance(model, LinearRegressionModel):
        rows = _rows("linear", 0, [model.coefficients.toArray()], [model.intercept])
    else:
        raise TypeError(f"{type(model).__name__} has no weight table")
    return spark.createDataFrame(rows, WEIGHTS)


# ---------------------------------------------------------------- scoring

def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_best(raw: Column) -> Column:
    """The smallest class of the largest score."""
    return _with(raw, lambda r: (F.array_position(r, F.array_max(r)) - 1).cast("double"))


def _numbers(values, kind: str) -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def _forest(nodes: list, x: Column) -> Column:
    trees: dict[int, dict[int, object]] = {}
    for r in nodes:
        trees.setdefault(r["tree"], {})[r["node"]] = r
    sums: Column | None = None
    for t in sorted(trees):
        tree = trees[t]
        size = max(tree) + 1
        at = [tree.get(i) for i in range(size)]
        depth, level = 0, [0]
        while level := [c for i in level for c in (at[i]["left"], at[i]["right"]) if c is not None]:
            depth += 1
        of = lambda name, none: [none if r is None or r[name] is None else r[name] for r in at]
        feature, left, right = _numbers(of("feature", -1), "int"), _numbers(of("left", 0), "int"), _numbers(of("right", 0), "int")
        cut = _numbers(of("threshold", math.nan), "double")
        sets = any(r is not None and r["left_set"] is not None for r in at)
        if sets:
            named = F.array(*[_numbers(r["left_set"] if r is not None and r["left_set"] is not None else [], "double") for r in at])
            known = _numbers(of("categories", -1), "int")

        def step(node: Column, _: Column) -> Column:
            value = F.get(x, F.get(feature, node))
            goes = value <= F.get(cut, node)
            if sets:
                here, n = F.get(named, node), F.get(known, node)
                goes = F.when(n < 0, goes).otherwise(F.array_contains(here, value) | ((value >= n) & (2 * F.size(here) > n)))
            # a null stays null to the end, so the row has no score
            return (F.when(F.get(feature, node) < 0, node).when(value.isNull(), F.lit(None).cast("int"))
                    .when(goes, F.get(left, node)).otherwise(F.get(right, node)))

        end = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) if depth else F.lit(0)
        width = max(len(r["votes"]) for r in tree.values() if r["votes"] is not None)
        votes = F.get(F.array(*[_numbers(r["votes"] if r is not None and r["votes"] is not None else [0.0] * width, "double")
                                for r in at]), end)
        sums = votes if sums is None else F.zip_with(sums, votes, lambda a, b: a + b)
    shares = lambda s: _with(F.aggregate(s, F.lit(0.0), lambda a, v: a + v),
                             lambda total: F.transform(s, lambda v: F.when(total == 0, v).otherwise(v / total)))
    return F.when(x.isNotNull(), _with(sums, shares))


def _layer(rows: list, x: Column) -> Column:
    outs: dict[int, dict[int, float]] = {}
    for r in rows:
        outs.setdefault(r["out"], {})[r["slot"]] = r["weight"]
    sums = []
    for o in sorted(outs):
        w = [outs[o].get(s, 0.0) for s in range(max(max(v) for v in outs.values()) + 1)]
        dot = F.aggregate(F.zip_with(_numbers(w, "double"), x, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        sums.append(dot + F.lit(float(outs[o].get(INTERCEPT, 0.0))))
    return F.array(*sums)


def _written_out(layers: list[list], x: Column, sigmoid: bool) -> Column:
    """The last layer's sums as plain arithmetic, which Spark compiles, computing what repeats once.  As every sum
    reads every input, a null or an array of another length leaves no sum at all."""
    width = _width(layers[0])
    right = F.when(F.size(x) == width, F.lit(0))
    values = [F.get(x, right + s) for s in range(width)]
    for k, rows in enumerate(layers):
        outs: dict[int, dict[int, float]] = {}
        for r in rows:
            outs.setdefault(r["out"], {})[r["slot"]] = float(r["weight"])
        sums = []
        for o in sorted(outs):
            dot = F.lit(0.0)
            for s in range(_width(rows)):
                dot = dot + F.lit(outs[o].get(s, 0.0)) * values[s]
            sums.append(dot + F.lit(outs[o].get(INTERCEPT, 0.0)))
        values = [1 / (1 + F.exp(-v)) for v in sums] if sigmoid and k < len(layers) - 1 else sums
    return F.get(F.array(F.array(*values)), F.when(values[0].isNotNull(), F.lit(0)))


def _width(rows: list) -> int:
    return max(r["slot"] for r in rows) + 1


def scorer(model: DataFrame) -> Callable[[Column], tuple[Column, Column]]:
    """``features array -> (raw, prediction)`` from a node or weight table, however it was written.

    ``raw`` holds the score of each class: shares of the votes of a forest, the last
    layer's sums of a perceptron, log likelihoods of naive Bayes, margins of a logistic
    model.  A linear model has one score, which is its prediction.
    """
    rows = model.collect()
    if not rows:
        raise ValueError("the model table has no rows")
    if "tree" in model.columns:
        def forest(x: Column) -> tuple[Column, Column]:
            raw = _with(x, lambda v: _forest(rows, v))
            return raw, first_best(raw)
        return forest
    kind = rows[0]["kind"]
    last = max(r["layer"] for r in rows)

    layers = [[r for r in rows if r["layer"] == k] for k in range(last + 1)]
    # each sum names all sums before it, so the expression has as many terms as the product of the widths
    written = math.prod([_width(mine) for mine in layers] + [len({r["out"] for r in layers[-1]})]) <= WRITTEN_OUT

    def weights(x: Column) -> tuple[Column, Column]:
        if written:
            raw = _written_out(layers, x, kind == "perceptron")
            return raw, F.get(raw, F.lit(0)) if kind == "linear" else first_best(raw)
        out = x
        for k in range(last + 1):
            out = _with(out, lambda v: _layer(layers[k], v))
            if kind == "perceptron" and k < last:
                out = F.transform(out, lambda v: 1 / (1 + F.exp(-v)))
        raw = _with(out, lambda s: F.when(F.aggregate(s, F.lit(True), lambda a, v: a & v.isNotNull()), s))
        return raw, F.get(raw, F.lit(0)) if kind == "linear" else first_best(raw)
    return weights


def score(df: DataFrame, model: DataFrame, features: Column, out: str = "prediction") -> DataFrame:
    """K1 without MLlib: ``df`` with the prediction of the model of a table."""
    return df.withColumn(out, scorer(model)(features)[1])
