"""Driver queries for models kept as tables, saved estimators and saved searches."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evstat.operators import features as feat, metrics, model_tables, models, prep, tune
from evstat.plans.catalog import query
from evstat.plans.modeling import _FIT_COLS, _NB_SQL, _indexed, _mllib_terms_sql, _model_frame, _spread
from evstat.plans.tables import table
from evstat.session import scratch_path
from evstat.sources import io


def _path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}/{uuid.uuid4().hex}")


def _stored(spark: SparkSession, model: DataFrame) -> DataFrame:
    """A model table written and read again, as a later job would find it."""
    path = _path(spark, "model-table")
    io.write_table(model, path)
    return io.read_table(spark, path, schema=model.schema)


# ============================================================ models as tables

_RULE_SQL = "case when l_quantity > 24 and l_discount >= 0.05 then 1 when l_quantity > 24 and l_tax < 0.03 then 2 else 0 end::double"


@query("forest_table_scores", f"""
select l_orderkey, l_linenumber, {_RULE_SQL} as prediction, true as as_fitted from lineitem
""")
def forest_table_scores(spark: SparkSession, sf: str) -> DataFrame:
    """C3 + K1: a forest learns three classes that thresholds of three measures decide; its nodes, written and
    read as a table, give every line its class, the one that MLlib gives."""
    big = F.col("l_quantity") > 24
    li = table(spark, sf, "lineitem").withColumn(
        "label", F.when(big & (F.col("l_discount") >= 0.05), 1.0).when(big & (F.col("l_tax") < 0.03), 2.0).otherwise(0.0))
    cols = ["l_quantity", "l_discount", "l_tax"]
    forest = models.random_forest().setFeatureSubsetStrategy("all").setMaxBins(64)
    fitted = models.fit_pipeline([feat.assembler(cols), forest], li.select("l_orderkey", "l_linenumber", *cols, "label"),
                                 keep=[*cols, "label"], **_spread(spark, sf))
    nodes = _stored(spark, model_tables.forest_nodes(spark, fitted.stages[-1], _path(spark, "forest")))
    both = models.score(fitted, li).withColumnRenamed("prediction", "by_mllib")
    both = model_tables.score(both, nodes, F.array(*[F.col(c).cast("double") for c in cols]))
    return both.select("l_orderkey", "l_linenumber", "prediction", (F.col("prediction") == F.col("by_mllib")).alias("as_fitted"))


@query("forest_table_tones", """
select l_orderkey, l_linenumber, true as as_fitted, true as same_shares from lineitem where l_extendedprice < 100000
""")
def forest_table_tones(spark: SparkSession, sf: str) -> DataFrame:
    """C3 on categories and a scale, where trees hold splits by sets of categories: class and shares are MLlib's on every line."""
    df = prep.greater_than(prep.with_cast(_model_frame(spark, sf), "cast(tone as tinyint)", "label"), "tone", 0)
    indexer, cols = _indexed(df)
    stages = [indexer, feat.assembler(cols, "joined"), feat.vector_indexer("joined", "features", 12), models.random_forest()]
    fitted = models.fit_pipeline(stages, df, keep=[*_FIT_COLS, "label"], **_spread(spark, sf))
    nodes = _stored(spark, model_tables.forest_nodes(spark, fitted.stages[-1], _path(spark, "forest")))
    raw, best = model_tables.scorer(nodes)(vector_to_array(F.col("features")))
    gap = F.aggregate(F.zip_with(raw, vector_to_array(F.col("probability")), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x)
    return models.score(fitted, df).select("l_orderkey", "l_linenumber", (best == F.col("prediction")).alias("as_fitted"),
                                           (gap < 1e-9).alias("same_shares"))


@query("perceptron_table_scores", """
select count(*) as n, 0::bigint as other_class, true as same_shares, true as learnt from lineitem
""")
def perceptron_table_scores(spark: SparkSession, sf: str) -> DataFrame:
    """C4 + K1: a 5-10-5-2 perceptron learns which lines cost more than 30000; its weights, written and read as a
    table, score every line as MLlib does, and 19 of 20 lines or more are right."""
    cols = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice"]
    li = table(spark, sf, "lineitem").withColumn("label", (F.col("l_extendedprice") > 30000).cast("double"))
    stages = [feat.assembler(cols, "vector"), feat.scaler("vector", "features", with_mean=True), models.perceptron(max_iter=30)]
    fitted = models.fit_pipeline(stages, li.select("l_orderkey", *dict.fromkeys(["l_linenumber", *cols]), "label"),
                                 keep=[*cols, "label"], **_spread(spark, sf))
    weights = _stored(spark, model_tables.weight_table(spark, fitted.stages[-1]))
    raw, _ = model_tables.scorer(weights)(vector_to_array(F.col("features")))
    # the sums in a column of their own, so that they are computed once, by compiled code
    rows = models.score(fitted, li).withColumn("raw", raw)
    gap = F.aggregate(F.zip_with("raw", vector_to_array(F.col("rawPrediction")), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x)
    rows = rows.select("label", "prediction", model_tables.first_best(F.col("raw")).alias("best"), gap.alias("gap"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("best") != F.col("prediction")).alias("other_class"),
                    (F.max("gap") < 1e-6).alias("same_shares"),
                    (F.avg((F.col("best") == F.col("label")).cast("double")) >= 0.95).alias("learnt"))


@query("bayes_table_scores", _NB_SQL)
def bayes_table_scores(spark: SparkSession, sf: str) -> DataFrame:
    """C2 + K1: naive Bayes scored from its table of log weights, held against its closed form."""
    df = prep.with_cast(_model_frame(spark, sf), "cast(tone as double)", "label")
    df = models.valid_class_labels(prep.greater_than(df, "tone", 0))
    split = prep.hash_split(df, "l_orderkey", 1, 10, exact=True)
    train, test = split.where(F.col("part") == "train"), split.where(F.col("part") == "test")
    indexer, cols = _indexed(df)
    fitted = models.fit_pipeline([indexer, feat.assembler(cols), models.naive_bayes()], train)
    weights = _stored(spark, model_tables.weight_table(spark, fitted.stages[-1]))
    scored = model_tables.score(models.score(fitted, test).drop("prediction"), weights, vector_to_array(F.col("features")))
    return scored.select("l_orderkey", "l_linenumber", "label",
                         models.prediction_to_label("prediction", models.label_values(train, "label")).alias("prediction"))


# ============================================================ stored predictions, estimators and searches

_LINE_SQL = """
with c as (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b from lineitem),
     p as (select l_extendedprice::double as y, a * l_quantity + b as p from lineitem, c),
     m as (select avg(y) as mean, avg(p) as mean_p from p)
"""


@query("stored_prediction_metrics", _LINE_SQL + """
select count(*) as n, round(sqrt(avg((y - p) * (y - p))), 4) as rmse, round(avg(abs(y - p)), 4) as mae,
       round(1 - sum((y - p) * (y - p)) / sum((y - mean) * (y - mean)), 8) as r2
from p, m
""")
def stored_prediction_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a line through all rows, from its table of weights, are written; the table is read and evaluated again."""
    li = table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").cast("double").alias("label"))
    fitted = models.fit_pipeline([feat.assembler(["l_quantity"]), models.linear_regression(reg_param=0.0, elastic_net=0.0)], li)
    weights = _stored(spark, model_tables.weight_table(spark, fitted.stages[-1]))
    out = _path(spark, "predictions")
    io.write_table(model_tables.score(li, weights, F.array(F.col("l_quantity").cast("double"))).select("label", "prediction"), out)
    m = metrics.regression_metrics(io.read_table(spark, out))
    return m.select("n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 8).alias("r2"))


@query("saved_estimator_terms", _mllib_terms_sql())
def saved_estimator_terms(spark: SparkSession, sf: str) -> DataFrame:
    """An unfitted pipeline is saved, loaded and only then fitted; its terms are those of the closed form."""
    path = _path(spark, "estimator")
    models.save(feat.pipeline([feat.assembler(["l_quantity"]), models.linear_regression(label="l_extendedprice")]), path)
    loaded = Pipeline.load(path)
    fitted = models.fit_pipeline(loaded.getStages(), table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"))
    weight = F.when(F.col("slot") < 0, F.round("weight", 4)).otherwise(F.round("weight", 6))
    return model_tables.weight_table(spark, fitted.stages[-1]).select(
        F.when(F.col("slot") < 0, "intercept").otherwise("l_quantity").alias("term"), weight.alias("coefficient"))


@query("saved_search_best", """
select 0.0::double as reg_param, true as fit_intercept,
       round(regr_slope(l_extendedprice + 3000 * l_quantity, l_quantity), 5) as slope,
       round(regr_intercept(l_extendedprice + 3000 * l_quantity, l_quantity), 3) as intercept
from lineitem
""")
def saved_search_best(spark: SparkSession, sf: str) -> DataFrame:
    """S12 + G3: a search over a penalty and an intercept is saved and loaded; the best pipeline is the least-squares line of all rows."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", F.pmod("l_orderkey", F.lit(3)).cast("int").alias("fold"),
                                             (F.col("l_extendedprice") + 3000 * F.col("l_quantity")).alias("cost"))
    line = models.linear_regression(label="cost", elastic_net=0.0)
    grid = ParamGridBuilder().addGrid(line.regParam, [0.0, 50_000.0]).addGrid(line.fitIntercept, [True, False]).build()
    found = tune.cross_validate(feat.pipeline([feat.assembler(["l_quantity"]), line]), grid, li, "cost", folds=3, fold_col="fold")
    path = _path(spark, "search")
    models.save(found, path)
    best = tune.best_params(CrossValidatorModel.load(path))
    fitted = models.load_best_of_cv(path).stages[-1]
    return spark.createDataFrame(
        [(float(best["regParam"]), bool(best["fitIntercept"]), round(float(fitted.coefficients[0]), 5), round(float(fitted.intercept), 3))],
        "reg_param double, fit_intercept boolean, slope double, intercept double")


# ============================================================ vector index and stage by type (M7, M9)

@query("vector_index", """
select l_orderkey, l_linenumber, dense_rank() over (order by l_linenumber) - 1.0::double as line_index,
       dense_rank() over (order by l_tax) - 1.0::double as tax_index, l_quantity::double as quantity
from lineitem
""")
def vector_index(spark: SparkSession, sf: str) -> DataFrame:
    """M7: slots of at most 20 values become indexes in their order, others stay."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_quantity")
    stages = [feat.assembler(["l_linenumber", "l_tax", "l_quantity"]), feat.vector_indexer("features", "indexed", 20)]
    x = vector_to_array(F.col("indexed"))
    return models.fit_pipeline(stages, li).transform(li).select(
        "l_orderkey", "l_linenumber", F.get(x, F.lit(0)).alias("line_index"), F.get(x, F.lit(1)).alias("tax_index"),
        F.get(x, F.lit(2)).alias("quantity"))


@query("stage_labels", """
select state as label, (row_number() over (order by count(*) desc, state) - 1)::integer as index from (
  select l_returnflag || l_linestatus as state from lineitem) group by 1
""")
def stage_labels(spark: SparkSession, sf: str) -> DataFrame:
    """M9: the fitted indexer of a pipeline, found by its type, and its labels by frequency."""
    li = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("state"), "l_quantity")
    stages = [feat.string_indexer("state", "i"), feat.assembler(["i", "l_quantity"])]
    labels = feat.stage_of_type(models.fit_pipeline(stages, li), StringIndexerModel).labels
    return spark.createDataFrame(list(enumerate(labels)), "index int, label string")
