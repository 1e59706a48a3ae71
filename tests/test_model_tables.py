"""Models kept as tables against MLlib and against plain Python replays."""

import math

import pytest
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import SF_SMALL
from evstat.operators import features as feat, model_tables, models


@pytest.fixture(scope="module")
def rows(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").withColumn("label", F.pmod("l_partkey", F.lit(3)).cast("double"))
    return VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax", "l_linenumber"], outputCol="features").transform(li)


def replay(nodes, x):
    """The prediction of one row by walking the stored nodes in Python."""
    sums = None
    for t in sorted({r["tree"] for r in nodes}):
        tree = {r["node"]: r for r in nodes if r["tree"] == t}
        at = tree[0]
        while at["feature"] >= 0:
            v = x[at["feature"]]
            left = v in at["left_set"] if at["left_set"] is not None else v <= at["threshold"]
            at = tree[at["left"] if left else at["right"]]
        sums = at["votes"] if sums is None else [a + b for a, b in zip(sums, at["votes"])]
    return float(sums.index(max(sums)))


def test_forest_with_numbers_and_categories(spark, rows, tmp_path):
    indexed = VectorIndexer(inputCol="features", outputCol="mixed", maxCategories=12).fit(rows).transform(rows)
    fitted = RandomForestClassifier(featuresCol="mixed", numTrees=5, maxDepth=6, maxBins=64, seed=3).fit(indexed)
    nodes = model_tables.forest_nodes(spark, fitted, str(tmp_path / "forest")).collect()
    table = spark.createDataFrame(nodes, model_tables.NODES)
    assert any(r["left_set"] for r in nodes) and any(r["threshold"] is not None for r in nodes)
    got = model_tables.score(fitted.transform(indexed).withColumnRenamed("prediction", "fitted"), table, vector_to_array(F.col("mixed")))
    assert got.where("prediction is null or prediction <> fitted").count() == 0
    for r in got.select("mixed", "prediction").limit(300).collect():
        assert replay(nodes, r["mixed"].toArray().tolist()) == r["prediction"]


def test_unseen_categories_go_where_mllib_sends_them(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 5), float(i % 5 in (1, 3, 4))) for i in range(200)], "c double, label double")
    df = VectorAssembler(inputCols=["c"], outputCol="raw").transform(df)
    index = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=5).fit(df)
    fitted = RandomForestClassifier(numTrees=3, seed=1).fit(index.transform(df))
    odd = spark.createDataFrame([(Vectors.dense([float(v)]),) for v in (0, 1, 4, 5, 9)], ["features"])
    table = model_tables.forest_nodes(spark, fitted, str(tmp_path / "f"))
    got = model_tables.score(fitted.transform(odd).withColumnRenamed("prediction", "fitted"), table, vector_to_array(F.col("features")))
    assert all(r.prediction == r.fitted for r in got.collect())


def test_one_leaf_forest_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(Vectors.dense([1.0]), 0.0)] * 4, ["features", "label"])
    fitted = RandomForestClassifier(numTrees=2, seed=1).fit(df)
    table = model_tables.forest_nodes(spark, fitted, str(tmp_path / "leaf"))
    x = spark.createDataFrame([([3.0],), (None,)], "x array<double>")
    assert [r.prediction for r in model_tables.score(x, table, F.col("x")).collect()] == [0.0, None]


def test_null_and_nan_features(spark, rows, tmp_path):
    fitted = RandomForestClassifier(numTrees=3, maxBins=64, seed=5).fit(rows)
    table = model_tables.forest_nodes(spark, fitted, str(tmp_path / "nan"))
    x = spark.createDataFrame([([None, 0.1, 0.1, 1.0],), ([math.nan] * 4,)], "x array<double>")
    got = [r.prediction for r in model_tables.score(x, table, F.col("x")).collect()]
    by_mllib = fitted.transform(spark.createDataFrame([(Vectors.dense([math.nan] * 4),)], ["features"])).first().prediction
    assert got == [None, by_mllib]


@pytest.mark.parametrize("name", ["two", "many", "threshold", "bayes", "perceptron", "linear"])
def test_weights_score_as_mllib(spark, rows, name):
    two = rows.withColumn("label", (F.col("l_quantity") + F.col("l_extendedprice") / 3000 > 40).cast("double"))
    if name == "two":
        fitted, df = LogisticRegression(maxIter=20).fit(two), two
    elif name == "threshold":
        fitted, df = LogisticRegression(maxIter=20, threshold=0.8).fit(two), two
    elif name == "many":
        fitted, df = LogisticRegression(maxIter=20, family="multinomial").fit(rows), rows
    elif name == "bayes":
        fitted, df = NaiveBayes().fit(rows), rows
    elif name == "perceptron":
        fitted, df = models.perceptron(layers=[4, 5, 3], max_iter=10).fit(rows), rows
    else:
        df = rows.withColumn("label", F.col("l_extendedprice").cast("double"))
        fitted = models.linear_regression(reg_param=0.0, elastic_net=0.0).fit(df)
    weights = model_tables.weight_table(spark, fitted)
    got = model_tables.score(fitted.transform(df).withColumnRenamed("prediction", "fitted"), weights, vector_to_array(F.col("features")))
    assert got.where("prediction is null or abs(prediction - fitted) > 1e-6").count() == 0
    none = spark.createDataFrame([([1.0, None, 1.0, 1.0],), (None,)], "x array<double>")
    assert [r.prediction for r in model_tables.score(none, weights, F.col("x")).collect()] == [None, None]


def test_what_has_no_table(spark, rows):
    with pytest.raises(TypeError):
        model_tables.weight_table(spark, StringIndexer(inputCol="l_returnflag", outputCol="i").fit(rows))
    with pytest.raises(ValueError):
        model_tables.weight_table(spark, NaiveBayes(modelType="gaussian").fit(rows))
    with pytest.raises(ValueError):
        model_tables.scorer(spark.createDataFrame([], model_tables.WEIGHTS))


def test_stage_of_a_missing_type(spark, rows):
    fitted = models.fit_pipeline([feat.assembler(["l_quantity"], "q")], rows)
    with pytest.raises(LookupError):
        feat.stage_of_type(fitted, VectorIndexer)


def test_written_out_sums_are_those_of_the_folds(spark, monkeypatch):
    """A perceptron as plain arithmetic and as folds: the same scores to the last bit, and none for odd arrays."""
    import random
    r = random.Random(4)
    rows = [("perceptron", k, o, s, r.gauss(0, 1)) for k, (a, b) in enumerate(((3, 4), (4, 2))) for o in range(b) for s in range(-1, a)]
    model = spark.createDataFrame(rows, model_tables.WEIGHTS)
    df = spark.createDataFrame([([r.gauss(0, 3) for _ in range(3)],) for _ in range(50)]
                               + [([1.0, None, 2.0],), ([1.0, 2.0],), ([1.0] * 4,), ([],), (None,)], "x array<double>")
    got = []
    for terms in (2000, 0):
        monkeypatch.setattr(model_tables, "WRITTEN_OUT", terms)
        raw, best = model_tables.scorer(model)(F.col("x"))
        assert ("aggregate" in df.select(raw.alias("raw"))._jdf.queryExecution().optimizedPlan().toString()) == (terms == 0)
        got.append(df.select(raw.alias("raw"), best.alias("best")).collect())
    assert got[0] == got[1] and [x.raw for x in got[0][50:]] == [None] * 5


def test_fits_read_bounded_tasks(spark, monkeypatch):
    """The partitions of a fit grow with the table, and columns that only order the rows are not kept."""
    from conftest import SF_SMALL
    from evstat.operators import models
    from evstat.plans import modeling
    few = modeling._spread(spark, SF_SMALL)["partitions"]
    assert few == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(modeling, "TASK_ROWS", 100)
    rows = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert modeling._spread(spark, SF_SMALL)["partitions"] >= rows / 100
    kept = models.training_frame(modeling._model_frame(spark, SF_SMALL), 4, ["l_orderkey"], ["GoldsteinScale"])
    assert kept.columns == ["GoldsteinScale"] and kept.rdd.getNumPartitions() == 4
    kept.unpersist()
