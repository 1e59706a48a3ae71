"""Metric aggregates vs MLlib evaluators; chi-square vs ChiSquareTest; closed form vs MLlib."""

import math

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from evstat.operators import chisq, features as feat, metrics, models, tune
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def preds(spark):
    # a label never predicted (2), a prediction never seen as label (3), perfect rows
    rows = [(0.0, 0.0)] * 5 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] * 4 + [(1.0, 0.0)] + [(2.0, 1.0)] * 3 + [(1.0, 3.0)]
    return spark.createDataFrame(rows, "label double, prediction double")


def test_classification_metrics_equal_mllib(preds):
    per = {r.label: r for r in metrics.per_label_metrics(preds).collect()}
    w = metrics.weighted_metrics(preds).first()
    ev = MulticlassClassificationEvaluator()
    for name, ours in [("accuracy", w.accuracy), ("weightedPrecision", w.weighted_precision),
                       ("weightedRecall", w.weighted_recall), ("f1", w.weighted_f_measure),
                       ("weightedFalsePositiveRate", w.weighted_false_positive_rate),
                       ("weightedTruePositiveRate", w.weighted_true_positive_rate)]:
        assert math.isclose(ours, ev.setMetricName(name).evaluate(preds), abs_tol=1e-12), name
    for lab in (0.0, 1.0, 2.0):
        for name, col in [("precisionByLabel", "precision"), ("recallByLabel", "recall"),
                          ("fMeasureByLabel", "f_measure"), ("falsePositiveRateByLabel", "false_positive_rate"),
                          ("truePositiveRateByLabel", "true_positive_rate")]:
            want = ev.setMetricName(name).setMetricLabel(lab).evaluate(preds)
            assert math.isclose(per[lab][col], want, abs_tol=1e-12), (name, lab)
    assert per[2.0].precision == 0.0  # never predicted
    assert metrics.accuracy(preds).first()[0] == w.accuracy


def test_regression_metrics_equal_mllib(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.0), (3.0, 3.5), (4.0, 4.0), (10.0, 7.0)],
                               "label double, prediction double")
    m = metrics.regression_metrics(df, num_features=1).first()
    ev = RegressionEvaluator()
    assert math.isclose(m.rmse, ev.setMetricName("rmse").evaluate(df), rel_tol=1e-12)
    assert math.isclose(m.mae, ev.setMetricName("mae").evaluate(df), rel_tol=1e-12)
    assert math.isclose(m.r2, ev.setMetricName("r2").evaluate(df), rel_tol=1e-12)
    assert math.isclose(m.explained_variance, ev.setMetricName("var").evaluate(df), rel_tol=1e-12)
    assert m.dof == 3
    r = metrics.residuals(df).agg(F.sum("residual")).first()[0]
    assert math.isclose(r, 3.0, abs_tol=1e-12)  # 20 - 17


def test_chi_square_equals_mllib(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.col("l_discount").cast("string").alias("disc"),
        F.when(F.col("l_quantity") > 25, "hi").otherwise("lo").alias("level"))
    li = li.withColumn("flag", F.nullif("flag", F.lit("N")))  # null as its own category
    ours = {r.feature: r for r in chisq.chi_square(li, ["flag", "status", "disc"], "level").collect()}
    ref = {r.feature: r for r in chisq.chi_square_mllib(li, ["flag", "status", "disc"], "level").collect()}
    for f in ("flag", "status", "disc"):
        assert ours[f].dof == ref[f].dof
        assert math.isclose(ours[f].statistic, ref[f].statistic, rel_tol=1e-9)
        assert math.isclose(ours[f].p_value, ref[f].p_value, rel_tol=1e-6, abs_tol=1e-12)


def _gamma_q_reference(a, x):
    """Independent upper regularised gamma: Lentz continued fraction (x >= a + 1)
    or 1 - series (x < a + 1), in plain Python."""
    lg = math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        ap = a
        while abs(term) > abs(total) * 1e-17:
            ap += 1.0
            term *= x / ap
            total += term
        return 1.0 - total * math.exp(-x + a * math.log(x) - lg)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    i = 1
    while True:
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
        i += 1
    return math.exp(-x + a * math.log(x) - lg) * h


def test_chi2_tail_against_reference(spark):
    cases = [(3.841458820694124, 1), (18.307038053275146, 10), (0.5, 1), (30.09, 25), (1.0, 7),
             (250.0, 212), (8831.34, 212), (17308.7557, 19), (0.0, 3), (201.8, 1)]
    df = spark.createDataFrame(cases, "stat double, dof int")
    got = [r.p for r in df.select(chisq.chi2_sf(F.col("stat"), F.col("dof")).alias("p")).collect()]
    assert math.isclose(got[0], 0.05, rel_tol=1e-9) and math.isclose(got[1], 0.05, rel_tol=1e-9)
    for (st, k), g in zip(cases, got):
        want = 1.0 if st == 0 else _gamma_q_reference(k / 2.0, st / 2.0)
        assert math.isclose(g, want, rel_tol=1e-9, abs_tol=1e-14), (st, k, g, want)
    assert got[7] == 0.0


def test_chi2_tail_of_huge_dof(spark):
    """Constant cost, and continuous where the integration takes over (normal limit for huge dof)."""
    rows = [(9999.0, 9999), (10101.0, 10001), (1e9 + 1.5 * math.sqrt(2e9), 10 ** 9), (5e9, 10 ** 9), (10.0, 10 ** 9),
            (1e12, 2)]
    df = spark.createDataFrame(rows, "stat double, dof bigint")
    got = [r.p for r in df.select(chisq.chi2_sf(F.col("stat"), F.col("dof")).alias("p")).collect()]
    for (st, k), g in list(zip(rows, got))[:2]:
        assert math.isclose(g, _gamma_q_reference(k / 2.0, st / 2.0), rel_tol=1e-8), (st, k)
    assert math.isclose(got[2], 0.5 * math.erfc(1.5 / math.sqrt(2)), rel_tol=1e-3)
    assert got[3] == 0.0 and got[4] == 1.0 and got[5] == 0.0


def test_chi_square_keeps_its_digits_at_1e12_rows(spark):
    from fractions import Fraction
    n = [[250_000_100_000, 249_999_950_000, 12_345], [249_999_900_000, 250_000_050_000, 0], [7, 0, 3]]
    cells = spark.createDataFrame([("f", None if i == 2 else str(i), str(j), x) for i, row in enumerate(n)
                                   for j, x in enumerate(row) if x], "feature string, value string, label string, n long")
    got = chisq.chi_square_of_cells(cells).first()
    r, c = [sum(x) for x in n], [sum(x) for x in zip(*n)]
    e = [[Fraction(a * b, sum(r)) for b in c] for a in r]
    want = float(sum((n[i][j] - e[i][j]) ** 2 / e[i][j] for i in range(3) for j in range(3)))
    assert math.isclose(got.statistic, want, rel_tol=1e-9) and got.dof == 4 and got.p_value == 0.0


def test_chi_square_with_many_labels(spark):
    """More classes than MLlib takes, by the same plan; equal to the sum over the whole grid."""
    df = spark.range(24000).select((F.col("id") % 12000).alias("label"), (F.col("id") % 7).cast("string").alias("f"))
    got = chisq.chi_square(df, "f", "label", with_p_value=False).first()
    n, cells, rows = 24000, {}, {}
    for i in range(n):
        cells[i % 7, i % 12000] = cells.get((i % 7, i % 12000), 0) + 1
        rows[i % 7] = rows.get(i % 7, 0) + 1
    want = sum(o * o / (rows[v] * 2 / n) for (v, _), o in cells.items()) - n
    assert got.dof == 6 * 11999 and math.isclose(got.statistic, want, rel_tol=1e-9)


def test_closed_form_elastic_net_equals_mllib(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    cf = models.elastic_net_1d(li, "l_quantity", "l_extendedprice").first()
    v = feat.assembler(["l_quantity"]).transform(li)
    m = models.linear_regression(label="l_extendedprice").fit(v)
    assert math.isclose(cf.coefficient, m.coefficients[0], rel_tol=1e-8)
    assert math.isclose(cf.intercept, m.intercept, rel_tol=1e-8)
    tab = models.coefficients_table(spark, m)
    assert tab.count() == 2
    hist = models.objective_history(spark, m).collect()
    assert hist[-1].objective <= hist[0].objective


def test_naive_bayes_index_maps_back_to_label(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense([5.0, 0.0]), 1.0), (Vectors.dense([4.0, 1.0]), 1.0),
                                (Vectors.dense([0.0, 5.0]), 3.0), (Vectors.dense([1.0, 4.0]), 3.0)],
                               ["features", "label"])
    m = models.naive_bayes().fit(df)
    raw = {r.prediction for r in m.transform(df).collect()}
    assert raw == {0.0, 1.0}  # MLlib returns indices
    fixed = m.transform(df).select("label", models.prediction_to_label("prediction", models.label_values(df)).alias("p"))
    assert all(r.label == r.p for r in fixed.collect())


def test_class_label_checks(spark):
    df = spark.createDataFrame([(-1.0,), (1.0,), (2.5,)], "label double")
    with pytest.raises(ValueError):
        models.check_class_labels(df)
    assert models.valid_class_labels(df).count() == 1


def test_save_load_score_roundtrip(spark, tmp_path):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(
        "l_returnflag", "l_linestatus", "l_quantity", F.col("l_extendedprice").alias("label"))
    pipe, _, _ = tune.hashed_regression(["l_returnflag", "l_linestatus", "l_quantity"], "label", 64)
    m = pipe.fit(li)
    path = str(tmp_path / "model")
    models.save(m, path)
    a = models.score(m, li).select("prediction")
    b = models.score(models.load_pipeline(path), li).select("prediction")
    assert a.exceptAll(b).count() == 0 and b.count() == li.count()
    models.save(models.linear_regression(), str(tmp_path / "estimator"))  # S11


def test_cross_validation_best_is_min(spark, tmp_path):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(
        "l_returnflag", "l_linestatus", "l_quantity", F.col("l_extendedprice").alias("label"))
    pipe, h, lr = tune.hashed_regression(["l_returnflag", "l_linestatus", "l_quantity"], "label")
    grid = tune.param_grid(h, lr, [0.0, 0.5], [True], [0.0], [64, 128])
    assert len(grid) == 4 and len(tune.param_grid(h, lr)) == 72
    cvm = tune.cross_validate(pipe, grid, li, "label", folds=3, parallelism=2)
    tab = tune.grid_table(spark, cvm).collect()
    assert tab[0].avg_metric == min(cvm.avgMetrics) and len(tab) == 4
    assert set(tune.best_params(cvm)) >= {"regParam", "numFeatures"}
    path = str(tmp_path / "cv")
    models.save(cvm, path)
    best = models.load_best_of_cv(path)
    assert best.transform(li).count() == li.count()


def test_classifiers_predict_known_labels(spark):
    from evstat.plans.modeling import naive_bayes, random_forest
    for q in (naive_bayes, random_forest):
        out = q(spark, SF_SMALL)
        labels = {r.label for r in out.select("label").distinct().collect()}
        preds = {r.prediction for r in out.select("prediction").distinct().collect()}
        assert labels <= {1.0, 2.0, 3.0, 4.0, 5.0}
        assert preds <= {1.0, 2.0, 3.0, 4.0, 5.0}  # label values, never class indices (T23)


def test_vector_indexer_and_train_validation_split(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense([float(i % 3), float(i)]), float(i)) for i in range(60)],
                               ["features", "label"])
    vi = feat.vector_indexer("features", "indexed", max_categories=5).fit(df)
    assert list(vi.categoryMaps.keys()) == [0]  # only the 3-valued slot is categorical
    pipe, h, lr = tune.hashed_regression(["label"], "label", 16)
    src = df.select("label")
    grid = tune.param_grid(h, lr, [0.0, 0.1], [True], [0.0], [16])
    tvs = tune.train_validation_split(pipe, grid, src, "label")
    assert len(tvs.validationMetrics) == 2


def test_association_report_parts(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.when(F.col("l_quantity") > 25, "hi").otherwise("lo").alias("level"))
    rep = chisq.association_report(li, ["flag", "status"], "level")
    assert rep["chi_square"].count() == 2
    assert rep["predictions"].count() == li.count()
    w = rep["weighted"].first()
    assert 0.0 <= w.accuracy <= 1.0
    assert rep["objective"].count() >= 1


def test_stage_of_type(spark):
    from pyspark.ml.regression import LinearRegressionModel
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_quantity", "l_extendedprice")
    m = models.fit_pipeline([feat.assembler(["l_quantity"]), models.linear_regression(label="l_extendedprice")], li)
    assert isinstance(feat.stage_of_type(m, LinearRegressionModel), LinearRegressionModel)
    with pytest.raises(LookupError):
        from pyspark.ml.classification import NaiveBayesModel
        feat.stage_of_type(m, NaiveBayesModel)


def test_feature_hasher_size_sum_determinism(spark):
    from pyspark.ml.functions import vector_to_array
    df = spark.createDataFrame([("a", "x", 2.5), ("b", "y", 0.0), ("a", "x", -1.0)], "s string, t string, v double")
    h = feat.hasher(["s", "t", "v"], "f", 1000)
    out = h.transform(df)
    again = h.transform(df)
    assert out.select("f").exceptAll(again.select("f")).count() == 0
    rows = out.select(F.size(vector_to_array("f")).alias("n"),
                      F.aggregate(vector_to_array("f"), F.lit(0.0), lambda a, x: a + x).alias("s"),
                      "v").collect()
    assert all(r.n == 1000 for r in rows)
    assert [round(r.s, 9) for r in rows] == [round(2 + r.v, 9) for r in rows]  # two strings add 1 each


def test_perceptron_and_logistic_properties(spark):
    from evstat.plans.modeling import logistic, mlp
    m = mlp(spark, SF_SMALL)
    assert m.count() == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").where("l_orderkey % 10 = 0").count()   # the test tenth
    assert {r.prediction for r in m.select("prediction").distinct().collect()} <= {0.0, 1.0}
    lg = logistic(spark, SF_SMALL)
    labels = {r.label for r in lg.select("label").distinct().collect()}
    assert {r.prediction for r in lg.select("prediction").distinct().collect()} <= labels


def test_regression_metrics_skip_unscored_rows_and_constant_labels(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (None, 1.0)], "label double, prediction double")
    r = metrics.regression_metrics(df).first()
    assert r["n"] == 2 and abs(r["rmse"] - 2.5 ** 0.5) < 1e-12
    r = metrics.regression_metrics(spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], df.schema)).first()
    assert r["r2"] is None and r["mse"] == 1.0
    assert metrics.regression_metrics(df.limit(0)).first()["rmse"] is None
    assert all(x["label"] is not None for x in metrics.per_label_metrics(df).collect())


def test_seeded_forest_does_not_depend_on_the_input_layout(spark):
    df = spark.range(3000).selectExpr("cast(id % 3 as double) as label", "cast(hash(id) % 100 as double) as x",
                                      "cast(id % 7 as double) as z")
    out = []
    for n in (2, 8):
        m = models.fit_pipeline([feat.assembler(["x", "z"]), models.random_forest()], df.repartition(n), partitions=4)
        out.append([r["prediction"] for r in m.transform(df.orderBy("label", "x", "z")).select("prediction").collect()])
    assert out[0] == out[1]
