"""Driver queries for chi-square, feature preparation, models, tuning and sinks.

Oracle twins exist where the result is SQL-expressible (contingency,
chi-square statistic and dof, index order, scaling, closed-form elastic
net, written-and-read tables).  Model fits are checked rows-only here and
by property tests in ``tests/``.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evstat.functions import exprs as X
from evstat.operators import chisq, describe, dictionary, features as feat, gram, logit, metrics, models, prep, tune
from evstat.plans.catalog import query
from evstat.plans.tables import CODE_SQL, COUNTRY_SQL, code_col, country_col, lineitem_key, table
from evstat.session import reliable_checkpoint, scratch_path
from evstat.sources import io

# ============================================================ chi-square input (A9, A10, T-1..T-3)

_CHI_SRC_SQL = f"""
d as (
  select cast(cast(round_even(l_quantity / 2, 0) as bigint) as varchar) as scale,
         cast(l_discount as varchar) as discount,
         cast(coalesce({CODE_SQL} = {COUNTRY_SQL}, false) as varchar) as is_same,
         case when l_extendedprice >= (select avg(l_extendedprice) from lineitem) then 'positive'
              when l_extendedprice < (select avg(l_extendedprice) from lineitem) then 'negative'
              else 'invalid' end as ToneLevel
  from lineitem)
"""


def chi_input(spark: SparkSession, sf: str) -> DataFrame:
    """Chi-square input of the reference's shape on ``lineitem``: rounded scale as
    text, a second category, the same-actor flag and a two-way tone level."""
    li = table(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", "l_extendedprice",
        code_col().alias("Actor1Code"), country_col().alias("Actor1CountryCode"))
    li = prep.with_mean_cut(li, "l_extendedprice", "mean_tone")
    level = X.bin_two_way("l_extendedprice", F.col("mean_tone"))
    return li.select(
        X.number_to_text(X.round_half_even(F.col("l_quantity") / 2)).alias("scale"),
        F.col("l_discount").cast("string").alias("discount"),
        X.same_flag("Actor1Code", "Actor1CountryCode").cast("string").alias("is_same"),
        level.alias("ToneLevel"),
        F.col("l_extendedprice").alias("AvgTone"))


def _chi_ctes(feats: list[str]) -> str:
    """CTEs ending in ``stats(feature, statistic, dof)``: Pearson's statistic over
    the full grid of values x labels (empty cells included), independent of the
    library's observed-cells identity."""
    cells = "\n  union all\n  ".join(
        f"select '{f}' as feature, {f} as value, ToneLevel as label, count(*) as n from d group by 2, 3"
        for f in feats)
    return f"""{_CHI_SRC_SQL},
cells as (
  {cells}),
rowt as (select feature, value, sum(n) as row_n from cells group by 1, 2),
colt as (select feature, label, sum(n) as col_n from cells group by 1, 2),
tot as (select feature, sum(n) as total from cells group by 1),
grid as (select r.feature, r.value, c.label, r.row_n, c.col_n
         from rowt r join colt c on r.feature = c.feature),
stats as (
  select g.feature,
         sum(power(coalesce(cells.n, 0) - g.row_n * g.col_n / t.total, 2)
             / (g.row_n * g.col_n / t.total)) as statistic,
         cast((count(distinct coalesce(g.value, '<null>')) - 1) * (count(distinct g.label) - 1) as bigint) as dof
  from grid g join tot t on g.feature = t.feature
  left join cells on g.feature = cells.feature and g.value is not distinct from cells.value
                  and g.label = cells.label
  group by g.feature)
"""


def _chi_sql(feats: list[str]) -> str:
    return f"with {_chi_ctes(feats)}select feature, round(statistic, 5) as statistic, dof from stats"


def _pvalue_sql(feats: list[str]) -> str:
    """Chi-square tail in SQL: ``1 - P(dof/2, stat/2)`` with the regularised
    lower gamma summed as a series in a recursive CTE (an independent route
    from the library's series / continued fraction)."""
    return f"""with recursive {_chi_ctes(feats)},
series(feature, k, term, a, x) as (
  select feature, 0, 1.0 / (dof / 2.0), dof / 2.0, statistic / 2.0 from stats
  union all
  select feature, k + 1, term * x / (a + k + 1), a, x from series
  where k < 1000000 and (k < x or term > 1e-17))
select s.feature, round(s.statistic, 5) as statistic, s.dof,
       round(1.0 - exp(any_value(a) * ln(any_value(x)) - any_value(x) - lgamma(any_value(a))) * sum(term), 9)
         as p_value
from series join stats s on series.feature = s.feature
group by s.feature, s.statistic, s.dof
"""


def _chi(spark: SparkSession, sf: str, feats: list[str]) -> DataFrame:
    r = chisq.chi_square(chi_input(spark, sf), feats, "ToneLevel", with_p_value=False)
    return r.select("feature", F.round("statistic", 5).alias("statistic"), "dof")


@query("chi_square_1", _chi_sql(["scale"]))
def chi_square_1(spark: SparkSession, sf: str) -> DataFrame:
    """T-1: tone level against the rounded scale."""
    return _chi(spark, sf, ["scale"])


@query("chi_square_2", _chi_sql(["scale", "discount"]))
def chi_square_2(spark: SparkSession, sf: str) -> DataFrame:
    """T-2: tone level against scale and a second category."""
    return _chi(spark, sf, ["scale", "discount"])


@query("chi_square_3", _chi_sql(["is_same", "scale", "discount"]))
def chi_square_3(spark: SparkSession, sf: str) -> DataFrame:
    """T-3: the same plus the boolean same-actor flag."""
    return _chi(spark, sf, ["is_same", "scale", "discount"])


@query("chi_square_pvalues", _pvalue_sql(["is_same", "scale", "discount"]))
def chi_square_pvalues(spark: SparkSession, sf: str) -> DataFrame:
    """T-3 with p-values (chi-square tail of each statistic)."""
    r = chisq.chi_square(chi_input(spark, sf), ["is_same", "scale", "discount"], "ToneLevel")
    return r.select("feature", F.round("statistic", 5).alias("statistic"), "dof",
                    F.round("p_value", 9).alias("p_value"))


@query("contingency", """
select 'o_orderpriority' as feature, o_orderpriority as value, o_orderstatus as label, count(*) as n
from orders group by 2, 3
""")
def contingency(spark: SparkSession, sf: str) -> DataFrame:
    """Observed cells of a feature against a label."""
    return chisq.contingency(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query("distinct_levels", """
select 'l_returnflag' as column, count(distinct l_returnflag) as levels from lineitem
union all select 'l_linestatus', count(distinct l_linestatus) from lineitem
union all select 'l_discount', count(distinct l_discount) from lineitem
union all select 'l_quantity', count(distinct l_quantity) from lineitem
""")
def distinct_levels(spark: SparkSession, sf: str) -> DataFrame:
    """A10: distinct categories per column, one scan."""
    return chisq.distinct_levels(table(spark, sf, "lineitem"),
                                 ["l_returnflag", "l_linestatus", "l_discount", "l_quantity"])


# ============================================================ feature preparation (M1-M5)

@query("string_index", """
select o_orderpriority as value,
       cast(row_number() over (order by count(*) desc, o_orderpriority) - 1 as double) as idx,
       count(*) as n
from orders group by o_orderpriority
""")
def string_index(spark: SparkSession, sf: str) -> DataFrame:
    """M1: MLlib ``StringIndexer`` (frequency desc, ties by label), index per value."""
    o = table(spark, sf, "orders").select("o_orderpriority")
    model = feat.string_indexer("o_orderpriority", "idx").fit(o)
    return model.transform(o).groupBy(F.col("o_orderpriority").alias("value"), "idx") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("string_index_table", """
select o_orderstatus as value, count(*) as n,
       cast(row_number() over (order by count(*) desc, o_orderstatus) - 1 as double) as idx
from orders group by o_orderstatus
""")
def string_index_table(spark: SparkSession, sf: str) -> DataFrame:
    """M1 as DataFrame code: label table with its index."""
    return feat.string_index_table(table(spark, sf, "orders"), "o_orderstatus")


@query("string_index_multi", """
with p as (select o_orderpriority as v, cast(row_number() over (order by count(*) desc, o_orderpriority) - 1 as double) as i
           from orders group by 1),
     s as (select o_orderstatus as v, cast(row_number() over (order by count(*) desc, o_orderstatus) - 1 as double) as i
           from orders group by 1)
select o.o_orderkey, p.i as priority_idx, s.i as status_idx
from orders o join p on o.o_orderpriority = p.v join s on o.o_orderstatus = s.v
""")
def string_index_multi(spark: SparkSession, sf: str) -> DataFrame:
    """M2: several columns indexed at once, ``handleInvalid='skip'``."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    cols = ["o_orderpriority", "o_orderstatus"]
    d = reliable_checkpoint(dictionary.label_dictionary(o, cols))
    return dictionary.with_indices(o, d, cols, ["priority_idx", "status_idx"], "skip").drop(*cols)


@query("string_index_keep", f"""
with l as (select l_orderkey, l_linenumber, {CODE_SQL} as code, cast(l_discount as varchar) as discount from lineitem),
     c as (select code as v, cast(row_number() over (order by count(*) desc, code) - 1 as double) as i from l where code is not null group by 1),
     d as (select discount as v, cast(row_number() over (order by count(*) desc, discount) - 1 as double) as i from l group by 1)
select l_orderkey, l_linenumber, coalesce(c.i, (select count(*) from c)::double) as code_idx, d.i as discount_idx
from l left join c on l.code = c.v join d on l.discount = d.v
""")
def string_index_keep(spark: SparkSession, sf: str) -> DataFrame:
    """M2: ``handleInvalid='keep'``: nulls take the number of labels as their index."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", code_col().alias("code"),
                                             F.col("l_discount").cast("string").alias("discount"))
    d = reliable_checkpoint(dictionary.label_dictionary(li, ["code", "discount"]))
    return dictionary.with_indices(li, d, ["code", "discount"], ["code_idx", "discount_idx"], "keep").drop("code", "discount")


@query("string_index_dictionary", """
with e as (select 'user_id' as "column", cast(user_id as varchar) as value from events union all select 'event_type', event_type from events)
select "column", value, count(*) as n,
       cast(row_number() over (partition by "column" order by count(*) desc, value) - 1 as double) as idx
from e where value is not null group by 1, 2
""")
def string_index_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """M2: the labels of several columns, one of them with very many, ranked in one range sort."""
    return dictionary.label_dictionary(table(spark, sf, "events"), ["user_id", "event_type"])


@query("assemble", f"""
select l_orderkey, l_linenumber, l_quantity as f0, l_discount as f1,
       cast(coalesce({CODE_SQL} = {COUNTRY_SQL}, false) as double) as f2
from lineitem
""")
def assemble(spark: SparkSession, sf: str) -> DataFrame:
    """M3: numeric and boolean columns to one vector (exposed as ``f0..f2``)."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount",
        X.same_flag(code_col(), country_col()).alias("is_same"))
    v = feat.assembler(["l_quantity", "l_discount", "is_same"]).transform(li)
    return v.select("l_orderkey", "l_linenumber", *feat.vector_columns("features", 3))


@query("standard_scale", """
select l_orderkey, l_linenumber,
       round(l_quantity / stddev_samp(l_quantity) over (), 9) as f0,
       round(l_extendedprice / stddev_samp(l_extendedprice) over (), 9) as f1
from lineitem
""")
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    """M5: MLlib ``StandardScaler`` (unit sample stddev, no centring)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    v = feat.assembler(["l_quantity", "l_extendedprice"], "vec").transform(li)
    s = feat.scaler("vec", "scaled").fit(v).transform(v)
    cols = feat.vector_columns("scaled", 2)
    return s.select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(f"f{i}") for i, c in enumerate(cols)])


@query("standard_scale_columns", """
select l_orderkey, l_linenumber,
       round(l_quantity / stddev_samp(l_quantity) over (), 9) as l_quantity_scaled,
       round(l_extendedprice / stddev_samp(l_extendedprice) over (), 9) as l_extendedprice_scaled
from lineitem
""")
def standard_scale_columns(spark: SparkSession, sf: str) -> DataFrame:
    """M5 as DataFrame code: all stddevs from one scalar subquery."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    s = feat.standard_scale(li, ["l_quantity", "l_extendedprice"])
    return s.select("l_orderkey", "l_linenumber",
                    F.round("l_quantity_scaled", 9).alias("l_quantity_scaled"),
                    F.round("l_extendedprice_scaled", 9).alias("l_extendedprice_scaled"))


# ============================================================ closed-form regression

def _enet_sql(where: str = "") -> str:
    return f"""
with m as (
  select count(*) as n, avg(l_quantity) as mx, avg(l_extendedprice) as my,
         stddev_pop(l_quantity) as sx, stddev_pop(l_extendedprice) as sy,
         corr(l_quantity, l_extendedprice) as r
  from lineitem {where}),
w as (select *, sign(r) * greatest(abs(r) - 0.8 * (0.3 / sy), 0.0) / (1 + 0.2 * (0.3 / sy)) as w from m),
c as (select n, mx, my, w * sy / sx as coefficient from w)
select n, round(coefficient, 9) as coefficient, round(my - coefficient * mx, 6) as intercept from c
"""


def _enet(df: DataFrame) -> DataFrame:
    r = models.elastic_net_1d(df, "l_quantity", "l_extendedprice")
    return r.select("n", F.round("coefficient", 9).alias("coefficient"),
                    F.round("intercept", 6).alias("intercept"))


@query("linreg_elastic", _enet_sql())
def linreg_elastic(spark: SparkSession, sf: str) -> DataFrame:
    """R1 + V13: one-feature elastic net (reg 0.3, mix 0.8) in closed form."""
    return _enet(table(spark, sf, "lineitem"))


@query("linreg_without_category", _enet_sql("where l_returnflag <> 'N'"))
def linreg_without_category(spark: SparkSession, sf: str) -> DataFrame:
    """The same fit without the dominant category."""
    return _enet(prep.not_equal(table(spark, sf, "lineitem"), "l_returnflag", "N"))


# ============================================================ sinks read back

@query("partitioned_roundtrip", """
select l_orderkey, l_linenumber, l_quantity, l_orderkey % 43 as key
from lineitem where l_orderkey % 43 in (3, 7, 11)
""")
def partitioned_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S6/S7 + S5 + F3: write partitioned by shard, read back one shard list
    (the shard filter prunes folders, only three are listed)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                              lineitem_key().alias("key"))
    path = scratch_path(spark, f"by_shard/{uuid.uuid4().hex}")
    io.write_table(li, path, partition_by=["key"])
    back = io.read_table(spark, path)
    return prep.in_shards(back, [3, 7, 11]).select("l_orderkey", "l_linenumber", "l_quantity",
                                                   F.col("key").cast("bigint").alias("key"))


@query("summary_csv_roundtrip", """
select cast(l_orderkey % 43 as integer) as _id, count(*) as count,
       round(avg(l_extendedprice), 4) as avg_tone, round(stddev_pop(l_extendedprice), 4) as sd_tone,
       round(avg(l_quantity), 6) as avg_scale, round(stddev_pop(l_quantity), 6) as sd_scale
from lineitem group by 1
""")
def summary_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Shard summary to parquet and to CSV with a header, CSV read back."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("AvgTone"), F.col("l_quantity").alias("GoldsteinScale"),
        lineitem_key().alias("key"))
    s = describe.shard_summary(li).select(
        "_id", "count", F.round("avg_tone", 4).alias("avg_tone"), F.round("sd_tone", 4).alias("sd_tone"),
        F.round("avg_scale", 6).alias("avg_scale"), F.round("sd_scale", 6).alias("sd_scale"))
    base = scratch_path(spark, f"summary/{uuid.uuid4().hex}")
    io.write_summary(s, f"{base}/parquet", f"{base}/csv")
    return spark.read.schema("_id int, count bigint, avg_tone double, sd_tone double, "
                             "avg_scale double, sd_scale double").option("header", True).csv(f"{base}/csv")


@query("chi_report_json", _chi_sql(["is_same", "scale", "discount"]))
def chi_report_json(spark: SparkSession, sf: str) -> DataFrame:
    """Chi-square report written as JSON and read back."""
    rep = chi_square_3(spark, sf)
    path = scratch_path(spark, f"chi_report/{uuid.uuid4().hex}")
    io.write_report(rep, path)
    return spark.read.schema("feature string, statistic double, dof bigint").json(path)


# ============================================================ models (rows-only)

def _model_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Prepared rows for the classifiers: four categories, a 0..1 scale, labels."""
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        X.fill_from(code_col(), country_col()).alias("Actor1Code"),
        country_col().alias("Actor1CountryCode"),
        F.col("l_discount").cast("string").alias("ActionGeo_CountryCode"),
        X.fill_literal(F.nullif(F.col("l_linestatus"), F.lit("F")), "").alias("Actor2Code"),
        X.rescale("l_quantity", 0, 50).alias("GoldsteinScale"),
        F.col("l_extendedprice").alias("AvgTone"),
        X.bin_ordinal("l_extendedprice", [5000, 20000, 40000, 70000, 100000]).alias("tone"),
        X.label_binary("l_extendedprice", 38000.0).cast("double").alias("label2"),
        lineitem_key().alias("key"))


TASK_ROWS = 500_000     # rows of a fit that one task reads, about


def _spread(spark: SparkSession, sf: str) -> dict:
    """Layout of an iterative fit: rows by the hash of their id over all cores, whatever the files they came in, as many
    times over as keeps a task at ``TASK_ROWS`` (the count comes from the files' footers)."""
    cores = spark.sparkContext.defaultParallelism
    turns = max(1, -(-table(spark, sf, "lineitem").count() // (cores * TASK_ROWS)))
    return {"partitions": cores * turns, "key": ["l_orderkey", "l_linenumber"]}


_CATS = ["ActionGeo_CountryCode", "Actor2Code", "Actor1Code", "Actor1CountryCode"]
_FIT_COLS = [*_CATS, "GoldsteinScale"]


def _indexed(df: DataFrame):
    si = feat.string_indexer(_CATS, ["s1", "s2", "s3", "s4"], "skip")
    return si, ["s1", "s2", "s3", "s4", "GoldsteinScale"]


# The reference's regularisation (0.3, mix 0.8) leaves no coefficient on these weakly
# associated features, so the fit predicts the most frequent label for every row.
_LABEL_SQL = f"""with {_CHI_SRC_SQL},
lab as (select ToneLevel, count(*) as n, cast(row_number() over (order by count(*) desc, ToneLevel) - 1 as double) as i
        from d group by 1)
"""


@query("logistic", _LABEL_SQL + """
select scale, discount, is_same, i as label, cast(0 as double) as prediction from d join lab using (ToneLevel)
""")
def logistic(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic regression on indexed categories (reg 0.3, mix 0.8), scored."""
    src = chi_input(spark, sf)
    stages = feat.index_and_assemble(["is_same", "scale", "discount"], "ToneLevel")
    lr = models.logistic_regression()
    m = models.fit_pipeline(stages + [lr], src)
    return models.score(m, src).select("scale", "discount", "is_same", "label", "prediction")


_NB_SQL = f"""
with base as (
  select row_number() over () as rid, l_orderkey, l_linenumber,
         cast(l_discount as varchar) as g,
         coalesce(nullif(l_linestatus, 'F'), '') as a2,
         coalesce({CODE_SQL}, {COUNTRY_SQL}) as a1,
         {COUNTRY_SQL} as c1,
         (l_quantity + 0) / 50 as x5,
         case when l_extendedprice < 5000 then 1 when l_extendedprice < 20000 then 2
              when l_extendedprice < 40000 then 3 when l_extendedprice < 70000 then 4
              when l_extendedprice < 100000 then 5 else -1 end as tone,
         case when l_orderkey % 10 = 0 then 'test' else 'train' end as part
  from lineitem),
lab as (select * from base where tone > 0),
train as (select * from lab where part = 'train'),
i1 as (select g as v, row_number() over (order by count(*) desc, g) - 1 as i from train group by g),
i2 as (select a2 as v, row_number() over (order by count(*) desc, a2) - 1 as i from train group by a2),
i3 as (select a1 as v, row_number() over (order by count(*) desc, a1) - 1 as i from train group by a1),
i4 as (select c1 as v, row_number() over (order by count(*) desc, c1) - 1 as i from train group by c1),
feats as (
  select b.rid, b.l_orderkey, b.l_linenumber, b.part, cast(b.tone as double) as tone,
         cast(i1.i as double) as x1, cast(i2.i as double) as x2, cast(i3.i as double) as x3,
         cast(i4.i as double) as x4, b.x5
  from lab b join i1 on b.g = i1.v join i2 on b.a2 = i2.v join i3 on b.a1 = i3.v join i4 on b.c1 = i4.v),
cls as (select tone, count(*) as n, sum(x1) as s1, sum(x2) as s2, sum(x3) as s3, sum(x4) as s4,
               sum(x5) as s5 from feats where part = 'train' group by tone),
tot as (select count(*) as k, sum(n) as total from cls),
model as (
  select tone as cls, ln(n + 1) - ln(total + k) as pi,
         ln(s1 + 1) - ln(s1 + s2 + s3 + s4 + s5 + 5) as t1, ln(s2 + 1) - ln(s1 + s2 + s3 + s4 + s5 + 5) as t2,
         ln(s3 + 1) - ln(s1 + s2 + s3 + s4 + s5 + 5) as t3, ln(s4 + 1) - ln(s1 + s2 + s3 + s4 + s5 + 5) as t4,
         ln(s5 + 1) - ln(s1 + s2 + s3 + s4 + s5 + 5) as t5
  from cls, tot),
scores as (
  select f.rid, f.l_orderkey, f.l_linenumber, f.tone as label, m.cls,
         m.pi + f.x1 * m.t1 + f.x2 * m.t2 + f.x3 * m.t3 + f.x4 * m.t4 + f.x5 * m.t5 as score
  from feats f, model m where f.part = 'test'),
ranked as (select *, row_number() over (partition by rid order by score desc, cls) as r from scores)
select l_orderkey, l_linenumber, label, cls as prediction from ranked where r = 1
"""


@query("naive_bayes", _NB_SQL)
def naive_bayes(spark: SparkSession, sf: str) -> DataFrame:
    """Multinomial naive Bayes on four indexed categories + a 0..1 scale.

    Trained on 9 of 10 id buckets, scored on the tenth; tone labels are
    checked (trap T8) and the predicted class index is mapped back to the
    tone value (trap T23).  Closed form in the oracle: priors
    ``log(n_c + 1) - log(N + K)``, likelihoods ``log(S_cj + 1) - log(S_c + D)``.
    """
    df = prep.with_cast(_model_frame(spark, sf), "cast(tone as double)", "label")
    df = models.valid_class_labels(prep.greater_than(df, "tone", 0))
    split = prep.hash_split(df, "l_orderkey", 1, 10, exact=True)
    train, test = split.where(F.col("part") == "train"), split.where(F.col("part") == "test")
    si, cols = _indexed(df)
    m = models.fit_pipeline([si, feat.assembler(cols), models.naive_bayes()], train)
    labels = models.label_values(train, "label")
    return models.score(m, test).select(
        "l_orderkey", "l_linenumber", "label",
        models.prediction_to_label("prediction", labels).alias("prediction"))


@query("bayes_test_accuracy", f"""
select count(*) as n, round(avg(case when label = prediction then 1.0::double else 0.0::double end), 9) as accuracy
from ({_NB_SQL})
""")
def bayes_test_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """C2 + V4: accuracy on the tenth of the ids that training never saw."""
    scored = naive_bayes(spark, sf)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(
        F.when(F.col("label") == F.col("prediction"), 1.0).otherwise(0.0)), 9).alias("accuracy"))


@query("forest_test_labels", """
select count(*) as n, true as known_labels
from lineitem where l_extendedprice < 100000 and l_orderkey % 10 = 0
""")
def forest_test_labels(spark: SparkSession, sf: str) -> DataFrame:
    """C3 + M6: the forest scores every unseen id, and its predictions are tones."""
    df = prep.greater_than(prep.with_cast(_model_frame(spark, sf), "cast(tone as tinyint)", "label"), "tone", 0)
    split = prep.hash_split(df, "l_orderkey", 1, 10, exact=True)
    si, cols = _indexed(df)
    stages = [si, feat.assembler(cols, "vectored"), feat.pca(5, "vectored", "features"), models.random_forest()]
    m = models.fit_pipeline(stages, split.where(F.col("part") == "train"), keep=[*_FIT_COLS, "label"], **_spread(spark, sf))
    scored = models.score(m, split.where(F.col("part") == "test"))
    return scored.agg(F.count(F.lit(1)).alias("n"),
                      F.bool_and(F.col("prediction").isin(1.0, 2.0, 3.0, 4.0, 5.0)).alias("known_labels"))


@query("random_forest")
def random_forest(spark: SparkSession, sf: str) -> DataFrame:
    """C3 + M6: PCA(5) of the indexed features, random forest with 6 trees."""
    df = prep.with_cast(_model_frame(spark, sf), "cast(tone as tinyint)", "label")
    df = prep.greater_than(df, "tone", 0)
    split = prep.hash_split(df, "l_orderkey", 1, 10)
    si, cols = _indexed(df)
    stages = [si, feat.assembler(cols, "vectored"), feat.pca(5, "vectored", "features"),
              models.random_forest()]
    m = models.fit_pipeline(stages, split.where(F.col("part") == "train"), keep=[*_FIT_COLS, "label"], **_spread(spark, sf))
    return models.score(m, split.where(F.col("part") == "test")).select(
        "l_orderkey", "l_linenumber", "label", "prediction")


@query("pca_features")
def pca_features(spark: SparkSession, sf: str) -> DataFrame:
    """M6: five principal components of the indexed features."""
    df = _model_frame(spark, sf)
    si, cols = _indexed(df)
    m = models.fit_pipeline([si, feat.assembler(cols, "vectored"), feat.pca(5, "vectored", "pca")], df, keep=_FIT_COLS, **_spread(spark, sf))
    return m.transform(df).select("l_orderkey", "l_linenumber", *feat.vector_columns("pca", 5, "pc"))


@query("mlp")
def mlp(spark: SparkSession, sf: str) -> DataFrame:
    """C4 + M5: scaled features into a 5-10-5-2 perceptron (two-label tone), trained
    on nine of ten id buckets and scored on the tenth."""
    df = _model_frame(spark, sf).withColumnRenamed("label2", "label")
    split = prep.hash_split(df, "l_orderkey", 1, 10, exact=True)
    si, cols = _indexed(df)
    stages = [si, feat.assembler(cols, "vector"), feat.scaler("vector", "features"), models.perceptron()]
    m = models.fit_pipeline(stages, split.where(F.col("part") == "train"), keep=[*_FIT_COLS, "label"], **_spread(spark, sf))
    return models.score(m, split.where(F.col("part") == "test")).select("l_orderkey", "l_linenumber", "label", "prediction")


@query("hash_features")
def hash_features(spark: SparkSession, sf: str) -> DataFrame:
    """M4: mixed string / numeric columns hashed to 1000 slots (no fit, map-only).

    Returns the sparse vector itself; densifying 1000 slots per row only
    to summarise them would cost more than the hashing.
    """
    df = _model_frame(spark, sf)
    h = feat.hasher(["Actor1Code", "Actor1CountryCode", "ActionGeo_CountryCode", "GoldsteinScale"],
                    "features", 1000)
    return h.transform(df).select("l_orderkey", "l_linenumber", "features")


@query("hash_feature_sums", """
select l_orderkey, l_linenumber, 1000 as slots, round(3 + (l_quantity + 0) / 50, 9) as total from lineitem
""")
def hash_feature_sums(spark: SparkSession, sf: str) -> DataFrame:
    """M4: three one-hot categories and the scale; slots that collide add up, so the
    sum of a hashed vector is known."""
    v = vector_to_array(F.col("features"))
    # the empty slots go first, in one pass of generated code, so the fold meets the few that hold a value
    total = F.aggregate(F.array_remove(v, 0.0), F.lit(0.0), lambda acc, x: acc + x)
    return hash_features(spark, sf).select("l_orderkey", "l_linenumber", F.size(v).alias("slots"),
                                           F.round(total, 9).alias("total"))


@query("linreg_mllib")
def linreg_mllib(spark: SparkSession, sf: str) -> DataFrame:
    """R1 with MLlib (cross-check of the closed form): coefficient table."""
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    m = models.fit_pipeline([feat.assembler(["l_quantity"]),
                             models.linear_regression(label="l_extendedprice")], li)
    return models.coefficients_table(spark, m.stages[-1])


def _mllib_terms_sql(where: str = "") -> str:
    return f"""
with m as (
  select avg(l_quantity) as mx, avg(l_extendedprice) as my,
         stddev_pop(l_quantity) as sx, stddev_pop(l_extendedprice) as sy,
         corr(l_quantity, l_extendedprice) as r
  from lineitem {where}),
c as (select mx, my, sign(r) * greatest(abs(r) - 0.8 * (0.3 / sy), 0.0) / (1 + 0.2 * (0.3 / sy)) * sy / sx as coef
      from m)
select 'l_quantity' as term, round(coef, 6) as coefficient from c
union all
select 'intercept', round(my - coef * mx, 4) from c
"""


def _mllib_terms(spark: SparkSession, li: DataFrame) -> DataFrame:
    m = models.fit_pipeline([feat.assembler(["l_quantity"]),
                             models.linear_regression(label="l_extendedprice")], li)
    tab = models.coefficients_table(spark, m.stages[-1])
    term = F.when(F.col("index") == -1, F.lit("intercept")).otherwise(F.lit("l_quantity"))
    rounded = F.when(F.col("index") == -1, F.round("coefficient", 4)).otherwise(F.round("coefficient", 6))
    return tab.select(term.alias("term"), rounded.alias("coefficient"))


@query("linreg_mllib_coefficients", _mllib_terms_sql())
def linreg_mllib_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """R1 + V13: MLlib's fitted terms (L-BFGS / OWL-QN), checked against the
    closed-form optimum of the same objective."""
    return _mllib_terms(spark, table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"))


@query("linreg_without_category_mllib", _mllib_terms_sql("where l_returnflag <> 'N'"))
def linreg_without_category_mllib(spark: SparkSession, sf: str) -> DataFrame:
    """R3 with MLlib: the same fit without the dominant category, checked
    against the closed form on the kept rows."""
    li = prep.not_equal(table(spark, sf, "lineitem"), "l_returnflag", "N")
    return _mllib_terms(spark, li.select("l_quantity", "l_extendedprice"))


# Elastic net of two or three features in closed form: with the signs of the coefficients known, the
# optimality conditions are linear.  Weights are small against the penalty only if a coefficient is 0.
def _index_cte(name: str, col: str, source: str) -> str:
    return (f"{name} as (select {col} as v, cast(row_number() over (order by count(*) desc, {col}) - 1 as double) as i "
            f"from {source} group by 1)")


_NET_SQL = """
p as (select 0.8 * 0.3 / sy as l1, 1 + 0.2 * 0.3 / sy as a, * from m),
dets as (select *, a*a*a + 2*r12*r13*r23 - a*(r12*r12 + r13*r13 + r23*r23) as det,
                a*a - r23*r23 as i11, r13*r23 - a*r12 as i12, r12*r23 - a*r13 as i13,
                a*a - r13*r13 as i22, r12*r13 - a*r23 as i23, a*a - r12*r12 as i33 from p),
signs as (select *, r1 - l1 * sign((i11*r1 + i12*r2 + i13*r3) / det) as h1,
                 r2 - l1 * sign((i12*r1 + i22*r2 + i23*r3) / det) as h2,
                 r3 - l1 * sign((i13*r1 + i23*r2 + i33*r3) / det) as h3 from dets),
fit as (select (i11*h1 + i12*h2 + i13*h3) / det * sy / s1 as b1, (i12*h1 + i22*h2 + i23*h3) / det * sy / s2 as b2,
               (i13*h1 + i23*h2 + i33*h3) / det * sy / s3 as b3, * from signs)
"""


@query("linreg_three_features", f"""with {_CHI_SRC_SQL.replace("end as ToneLevel", "end as ToneLevel, l_extendedprice as y")},
{_index_cte("f1", "is_same", "d")}, {_index_cte("f2", "scale", "d")}, {_index_cte("f3", "discount", "d")},
x as (select f1.i as x1, f2.i as x2, f3.i as x3, y from d join f1 on d.is_same = f1.v join f2 on d.scale = f2.v join f3 on d.discount = f3.v),
m as (select avg(x1) as m1, avg(x2) as m2, avg(x3) as m3, avg(y) as my, stddev_pop(x1) as s1, stddev_pop(x2) as s2, stddev_pop(x3) as s3,
             stddev_pop(y) as sy, corr(x1, x2) as r12, corr(x1, x3) as r13, corr(x2, x3) as r23, corr(x1, y) as r1, corr(x2, y) as r2,
             corr(x3, y) as r3 from x),
{_NET_SQL}
select 0 as slot, round(b1, 5) as coefficient from fit union all select 1, round(b2, 5) from fit union all select 2, round(b3, 5) from fit
union all select -1, round(my - b1 * m1 - b2 * m2 - b3 * m3, 4) from fit
""")
def linreg_three_features(spark: SparkSession, sf: str) -> DataFrame:
    """Elastic net of the tone on the three indexed case-3 features, from one pass of
    cross-moments (slot -1: intercept)."""
    src = chi_input(spark, sf)
    m = models.fit_pipeline(feat.index_and_assemble(["is_same", "scale", "discount"]), src)
    rows = models.score(m, src).select(gram.items("features").alias("items"), F.col("AvgTone").alias("label"))
    digits = F.when(F.col("slot") == gram.CONST, F.round("coefficient", 4)).otherwise(F.round("coefficient", 5))
    return gram.fit_table(rows).select("slot", digits.alias("coefficient"))


@query("linreg_indexed", f"""with {_index_cte("f2", "l_returnflag", "lineitem")},
x as (select l_orderkey, l_linenumber, l_quantity as x1, f2.i as x2, l_extendedprice as y from lineitem join f2 on l_returnflag = f2.v),
m as (select avg(x1) as m1, avg(x2) as m2, avg(y) as my, stddev_pop(x1) as s1, stddev_pop(x2) as s2, 1.0::double as s3, stddev_pop(y) as sy,
             corr(x1, x2) as r12, 0.0::double as r13, 0.0::double as r23, corr(x1, y) as r1, corr(x2, y) as r2, 0.0::double as r3 from x),
{_NET_SQL}
select l_orderkey, l_linenumber, l_quantity, l_returnflag, round(my + b1 * (l_quantity - m1) + b2 * (f2.i - m2), 4) as prediction
from lineitem join f2 on l_returnflag = f2.v, fit
""")
def linreg_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """R2: price on quantity plus the string-indexed return flag, from cross-moments, scored."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                              "l_returnflag", "l_extendedprice")
    stages = [StringIndexer(inputCol="l_returnflag", outputCol="flag_idx", handleInvalid="keep"),
              feat.assembler(["l_quantity", "flag_idx"])]
    rows = models.score(models.fit_pipeline(stages, li), li).withColumn("items", gram.items("features"))
    fitted = gram.fit_table(rows, label="l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag",
                       F.round(gram.predict("items", fitted), 4).alias("prediction"))


_HASHED = ["Actor1Code", "Actor1CountryCode", "ActionGeo_CountryCode", "GoldsteinScale"]


def _hashed_rows(spark: SparkSession, sf: str) -> DataFrame:
    hashed = feat.hasher(_HASHED, "features", 1000).transform(_model_frame(spark, sf))
    return hashed.withColumn("items", gram.items("features"))


@query("linreg_hashed")
def linreg_hashed(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed categories + scale, price as label, least squares from cross-moments."""
    rows = _hashed_rows(spark, sf)
    p = gram.predict("items", gram.fit_table(rows, label="AvgTone", reg=0.0, net=0.0))
    return rows.select("l_orderkey", "l_linenumber", "AvgTone", p.alias("prediction"))


@query("linreg_hashed_residuals", f"""
with l as (select coalesce({CODE_SQL}, {COUNTRY_SQL}) as a, {COUNTRY_SQL} as c, cast(l_discount as varchar) as g from lineitem)
select 'Actor1Code' as feature, a as level, count(*) as n, 0.0::double as mean_residual from l group by a
union all select 'Actor1CountryCode', c, count(*), 0.0 from l group by c
union all select 'ActionGeo_CountryCode', g, count(*), 0.0 from l group by g
union all select 'GoldsteinScale', 'times residual', count(*), 0.0 from l
""")
def linreg_hashed_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """R5's optimality on the rows: a least-squares fit leaves no mean residual in any level
    of a hashed category, and none weighed by the scale."""
    rows = _hashed_rows(spark, sf)
    p = gram.predict("items", gram.fit_table(rows, label="AvgTone", reg=0.0, net=0.0))
    r = F.col("AvgTone") - p
    levels = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("level"), r.alias("r")) for c in _HASHED[:3]]
    scale = F.struct(F.lit("GoldsteinScale").alias("feature"), F.lit("times residual").alias("level"), (r * F.col("GoldsteinScale")).alias("r"))
    each = rows.select(F.inline(F.array(*levels, scale)))
    return each.groupBy("feature", "level").agg(F.count("*").alias("n"), F.round(F.abs(F.avg("r")), 4).alias("mean_residual"))


def _grid_fits(spark: SparkSession, sf: str) -> DataFrame:
    """The 72-point grid, 5 folds, on nine of ten id buckets of the whole table: one read."""
    df = _model_frame(spark, sf).withColumns({
        "label": X.rescale("AvgTone", 20, 40),
        # deterministic folds: recomputing a lost partition gives the same split
        "fold": prep.shard_key(F.struct("l_orderkey", "l_linenumber"), tune.NUM_FOLDS).cast("int")})
    train = prep.hash_split(df, "l_orderkey", 1, 10, exact=True).where(F.col("part") == "train")
    for k in tune.GRID_NUM_FEATURES:
        train = feat.hasher(_HASHED, f"hashed_{k}", k).transform(train)
    return gram.search(train, {k: f"hashed_{k}" for k in tune.GRID_NUM_FEATURES}, "label", "fold",
                       tune.GRID_REG_PARAM, tune.GRID_FIT_INTERCEPT, tune.GRID_ELASTIC_NET)


@query("cv_grid")
def cv_grid(spark: SparkSession, sf: str) -> DataFrame:
    """5-fold search over the 72-point grid from one pass of cross-moments; ranked table."""
    return gram.ranked(_grid_fits(spark, sf))


@query("cv_grid_optimality", """
with held as (select count(*) as n from lineitem where l_orderkey % 10 <> 0)
select r.reg_param, f.fit_intercept, e.elastic_net, k.num_features, cast(5 as bigint) as folds, cast(held.n as bigint) as rows_held, true as optimal
from (values (0.0::double), (0.1), (0.3), (0.5)) r(reg_param), (values (true), (false)) f(fit_intercept),
     (values (0.0::double), (0.5), (1.0)) e(elastic_net), (values (1000), (3000), (5000)) k(num_features), held
""")
def cv_grid_optimality(spark: SparkSession, sf: str) -> DataFrame:
    """Every fit of the search meets its KKT conditions, and the folds hold every row once."""
    point = ["reg_param", "fit_intercept", "elastic_net", "num_features"]
    return _grid_fits(spark, sf).groupBy(*point).agg(
        F.count("*").alias("folds"), F.sum("n").cast("long").alias("rows_held"), (F.max("violation") < 1e-8).alias("optimal"))


@query("model_roundtrip")
def model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S10 + S12-style load + K1: fit on nine of ten id buckets, save, load, score the tenth, evaluate."""
    df = _model_frame(spark, sf).withColumn("label", F.col("AvgTone"))
    split = prep.hash_split(df, "l_orderkey", 1, 10, exact=True)
    train, test = split.where(F.col("part") == "train"), split.where(F.col("part") == "test")
    pipe, _, _ = tune.hashed_regression(
        ["Actor1Code", "Actor1CountryCode", "ActionGeo_CountryCode", "GoldsteinScale"], "label")
    m = models.fit_pipeline(pipe.getStages(), train, **_spread(spark, sf))
    path = scratch_path(spark, f"model/{uuid.uuid4().hex}")
    models.save(m, path)
    loaded = models.load_pipeline(path)
    scored = models.score(loaded, test).select("label", "prediction")
    out = scratch_path(spark, f"fitted/{uuid.uuid4().hex}")
    io.write_table(scored, out)
    return metrics.regression_metrics(io.read_table(spark, out))


# ============================================================ reports and views (S13-S15, A3/A4, T-4, V12)

@query("preview_orders", """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
from orders order by o_orderkey limit 20
""")
def preview_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The default 20-row preview, in a defined order."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                          "o_totalprice", "o_orderpriority")
    return io.preview(o, 20, ["o_orderkey"])


@query("cached_view_sql", """
select o_orderpriority, count(*) as n, round(avg(o_totalprice), 4) as avg_price
from orders where o_totalprice is not null and o_orderpriority is not null group by 1
""")
def cached_view_sql(spark: SparkSession, sf: str) -> DataFrame:
    """S13 + S14: a named view, cached, queried with SQL, then released."""
    view = f"orders_{uuid.uuid4().hex[:8]}"
    io.register_view(table(spark, sf, "orders").select("o_orderpriority", "o_totalprice"), view)
    io.cache_view(spark, view)
    path = scratch_path(spark, f"cached_view/{uuid.uuid4().hex}")
    try:
        out = spark.sql(f"select o_orderpriority, count(*) as n, round(avg(o_totalprice), 4) as avg_price "
                        f"from {view} where o_totalprice is not null and o_orderpriority is not null "
                        f"group by o_orderpriority")
        io.write_table(out, path)  # materialise before the cache is released
    finally:
        io.uncache_view(spark, view)
    return io.read_table(spark, path)


@query("summary_spark")
def summary_spark(spark: SparkSession, sf: str) -> DataFrame:
    """A3/A4 as Spark prints them (``df.summary``, GK percentiles): rows-only."""
    ev = table(spark, sf, "events").select("value", "user_id", "event_type")
    return describe.summary_approx(ev, "count", "mean", "stddev", "25%", "75%")


@query("association_report", _LABEL_SQL + """,
c as (select i as label, n as support, cast(sum(n) over () as bigint) as total, i = 0 as top from lab),
k as (select *, case when top then support else 0 end as tp, case when top then total - support else 0 end as fp,
             case when top then 0 else support end as fn, case when top then 0 else total - support end as tn from c),
r as (select *, case when fp > 0 then fp / (fp + tn) else 0.0::double end as false_positive_rate,
             tp / support as recall, case when top then tp / total else 0.0::double end as precision from k)
select label, support, tp, fp, fn, tn, false_positive_rate, recall as true_positive_rate, precision, recall,
       case when top then 2::double * precision * recall / (precision + recall) else 0.0::double end as f_measure
from r
""")
def association_report(spark: SparkSession, sf: str) -> DataFrame:
    """T-4: chi-square + logistic model + per-label metrics of its predictions."""
    rep = chisq.association_report(chi_input(spark, sf), ["is_same", "scale", "discount"], "ToneLevel")
    return rep["by_label"]


@query("logistic_objective")
def logistic_objective(spark: SparkSession, sf: str) -> DataFrame:
    """Objective per iteration of the case-3 logistic model."""
    rep = chisq.association_report(chi_input(spark, sf), ["is_same", "scale", "discount"], "ToneLevel")
    return rep["objective"]


def _revenue_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Data with signal: is a line's revenue above its mean, from its price band, rounded quantity and discount."""
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    li = li.withColumn("revenue", F.col("l_extendedprice") * F.col("l_quantity") * (1 - F.col("l_discount")))
    li = prep.with_mean_cut(li, "revenue", "mean_revenue")
    return li.select(X.bin_ordinal("l_extendedprice", [5000, 20000, 40000, 70000, 100000]).alias("band"),
                     X.round_half_even(F.col("l_quantity") / 2).alias("scale"), F.col("l_discount").alias("discount"),
                     X.label_binary("revenue", F.col("mean_revenue")).alias("label"))


@query("logistic_signal_optimality", """
select * from (values ('band', true), ('scale', true), ('discount', true), ('intercept', true),
                      ('has coefficients', true), ('objective falls', true), ('better than the share', true)) t("check", holds)
""")
def logistic_signal_optimality(spark: SparkSession, sf: str) -> DataFrame:
    """The fit (reg 0.05, mix 0.8) on data with signal; its optimality conditions summed over all rows."""
    rows = _revenue_rows(spark, sf)
    names = ["band", "scale", "discount"]
    reg, net = 0.05, 0.8
    m = logit.fit(rows, names, "label", reg=reg, net=net)
    p = m.probability()
    y = F.col("label").cast("double")
    one = rows.agg(F.avg(p - y).alias("intercept"), *[F.avg((p - y) * F.col(c)).alias(f"g_{c}") for c in names],
                   *[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")).alias(c) for c in names],
                   F.avg(((p >= 0.5) == (y == 1)).cast("double")).alias("accuracy"), F.greatest(F.avg(y), 1 - F.avg(y)).alias("share"))
    checks = []
    for c, w in zip(names, m.coefficients, strict=True):
        weight = F.lit(float(w)) * F.col(c)["sd"]
        slope = (F.col(f"g_{c}") - F.col("intercept") * F.col(c)["mean"]) / F.col(c)["sd"] + reg * (1 - net) * weight
        ok = F.abs(slope + reg * net * F.signum(weight)) < 1e-6 if w else F.abs(slope) <= reg * net + 1e-6
        checks.append(F.struct(F.lit(c).alias("check"), ok.alias("holds")))
    falls = all(a >= b for a, b in zip(m.history, m.history[1:], strict=False)) and m.history[0] - m.history[-1] > 0.01
    checks += [F.struct(F.lit(n).alias("check"), ok.alias("holds")) for n, ok in (
        ("intercept", F.abs("intercept") < 1e-6), ("has coefficients", F.lit(bool(np.count_nonzero(m.coefficients) >= 2))),
        ("objective falls", F.lit(falls)), ("better than the share", F.col("accuracy") > F.col("share") + 0.05))]
    return one.select(F.inline(F.array(*checks)))


@query("logistic_signal_objective")
def logistic_signal_objective(spark: SparkSession, sf: str) -> DataFrame:
    """Objective after every step on data with signal."""
    return logit.fit(_revenue_rows(spark, sf), ["band", "scale", "discount"], "label", reg=0.05).objective_table(spark)
