"""Driver queries for exact splits and components, committed tables and quarantined lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evstat.operators import comoments, shard_state, split
from evstat.plans.catalog import query
from evstat.plans.tables import events_with_gaps, lineitem_key, table
from evstat.session import scratch_path
from evstat.sources import clustered, quarantine, versions

# ============================================================ exact split


@query("exact_split", """
with d as (select l_orderkey, l_linenumber,
                  row_number() over (order by md5('42:' || l_orderkey || ':' || l_linenumber)) - 1 as place,
                  count(*) over () as n
           from lineitem)
select l_orderkey, l_linenumber,
       case when place < floor(n * 1 / 10.0 + 0.5) then 'test'
            when place < floor(n * 3 / 10.0 + 0.5) then 'tune' else 'train' end as part
from d
""")
def exact_split(spark: SparkSession, sf: str) -> DataFrame:
    """every line in one of three parts of exactly 10, 20 and 70 percent."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return split.exact_split(li, ["l_orderkey", "l_linenumber"], [0.1, 0.2, 0.7], ["test", "tune", "train"])


@query("exact_split_groups", """
with g as (select l_orderkey, md5('7:' || l_orderkey) as d, count(*) as n from lineitem group by 1),
     r as (select l_orderkey, sum(n) over (order by d) - n as first, sum(n) over (order by d) as past,
                  sum(n) over () as total from g),
     c as (select l_orderkey, floor(total * 1 / 4.0 + 0.5) as cut, first, past from r)
select l_orderkey, past - first as n,
       case when first >= cut then 1 when past <= cut then 0
            when 2 * (cut - first) < past - first then 1 else 0 end as part
from c
""")
def exact_split_groups(spark: SparkSession, sf: str) -> DataFrame:
    """F13 by order: the lines of an order stay together, a quarter to three quarters of the lines."""
    li = table(spark, sf, "lineitem").select("l_orderkey")
    return split.exact_split(li, ["l_orderkey"], [1, 3], seed=7).groupBy("l_orderkey", "part").agg(F.count("*").alias("n"))


# ============================================================ principal components (M6)

_PCA_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _pca_sql(fn: str, digits: int) -> str:
    pairs = [f"select '{a}' as a, '{b}' as b, round({fn}({a}::double, {b}::double), {digits}) + 0.0 as moment, "
             f"{1.0 if a == b else 0.0}::double as unit from lineitem" for a in _PCA_COLS for b in _PCA_COLS]
    return " union all ".join(pairs)


def _rebuilt(spark: SparkSession, sf: str, scale: bool, digits: int) -> DataFrame:
    """The matrix that the components and their variances make up again, and the one of their products: only
    orthonormal eigenvectors with their eigenvalues give the matrix of the rows and the unit matrix."""
    t = comoments.principal_components(table(spark, sf, "lineitem"), _PCA_COLS, scale=scale).table(spark)
    a = t.select("component", "variance", F.col("col").alias("a"), F.col("weight").alias("wa"))
    b = t.select("component", F.col("col").alias("b"), F.col("weight").alias("wb"))
    both = F.col("wa") * F.col("wb")
    return a.join(b, "component").groupBy("a", "b").agg(
        (F.round(F.sum(both * F.col("variance")), digits) + 0.0).alias("moment"), (F.round(F.sum(both), 6) + 0.0).alias("unit"))


@query("pca_covariance", _pca_sql("covar_samp", 3))
def pca_covariance(spark: SparkSession, sf: str) -> DataFrame:
    """M6: components of five measures of all lines, checked by the covariances that they rebuild."""
    return _rebuilt(spark, sf, False, 3)


@query("pca_correlation", _pca_sql("corr", 6))
def pca_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """M6 on columns of unit variance, checked by the correlations."""
    return _rebuilt(spark, sf, True, 6)


@query("pca_score_means", """
select count(*) as n, round(sum(l_quantity::double) + 0.0, 2) as qty from lineitem
""")
def pca_score_means(spark: SparkSession, sf: str) -> DataFrame:
    """M6 scores as expressions: the scores of all components of a row give its quantity back."""
    li = table(spark, sf, "lineitem")
    pc = comoments.principal_components(li, _PCA_COLS)
    back = sum((F.col(f"pc{k}") * float(pc.weights[k, 0]) for k in range(len(_PCA_COLS))), F.lit(0.0))
    return li.select(*pc.scores()).agg(F.count("*").alias("n"), F.round(F.sum(back), 2).alias("qty"))


# ============================================================ committed tables

@query("committed_refresh", """
select l_orderkey, l_linenumber, l_orderkey % 43 as key,
       case when l_orderkey % 43 in (3, 7) then l_quantity * 2 else l_quantity end::double as l_quantity
from lineitem
""")
def committed_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """The lines by shard, overwritten in whole, then two shards refreshed from the table itself."""
    path = scratch_path(spark, f"committed/{uuid.uuid4().hex}")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", lineitem_key().alias("key"),
                                             F.col("l_quantity").cast("double").alias("l_quantity"))
    versions.overwrite(li, path, ["key"])
    shards = versions.read(spark, path).where(F.col("key").isin(3, 7))
    versions.refresh(shards.withColumn("l_quantity", F.col("l_quantity") * 2), path)
    return versions.read(spark, path)


# ============================================================ quarantine

_LINE = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
                      T.StructField("qty", T.IntegerType()), T.StructField("flag", T.StringType())])


@query("quarantined_lines", """
with t as (select l_orderkey, l_linenumber, l_quantity::bigint as qty, l_returnflag as flag,
                  case when l_orderkey % 11 = 0 then 'fields' when l_orderkey % 13 = 0 then 'type:qty' end as reason
           from lineitem)
select reason, case when reason is null then l_orderkey end as l_orderkey,
       case when reason is null then l_linenumber end as l_linenumber, case when reason is null then qty end as qty,
       case when reason = 'fields' then concat_ws(chr(9), l_orderkey, l_linenumber, qty)
            when reason is not null then concat_ws(chr(9), l_orderkey, l_linenumber, 'many', flag) end as raw
from t
""")
def quarantined_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines written as text, some a field short and some with a word for a number, read back in two tables."""
    key, qty = F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("bigint").cast("string")
    short, word = F.pmod("l_orderkey", F.lit(11)) == 0, F.pmod("l_orderkey", F.lit(13)) == 0
    line = F.concat_ws("\t", key, F.col("l_linenumber").cast("string"), F.when(word & ~short, F.lit("many")).otherwise(qty),
                       F.when(~short, F.col("l_returnflag")))
    path = scratch_path(spark, f"lines/{uuid.uuid4().hex}")
    table(spark, sf, "lineitem").select(line.alias("value")).write.text(path)
    good, bad = quarantine.read_checked(spark, path, _LINE)
    none = F.lit(None)
    return good.select(none.cast("string").alias("reason"), "l_orderkey", "l_linenumber", "qty", none.cast("string").alias("raw")).unionByName(
        bad.select("reason", none.cast("long").alias("l_orderkey"), none.cast("int").alias("l_linenumber"), none.cast("int").alias("qty"),
                   F.col("raw").cast("string").alias("raw")))


# ============================================================ shard states (A2, A3)

@query("shard_state_refresh", """
with t as (select l_quantity::double as l_quantity,
                  case when l_orderkey % 43 = 6 then l_extendedprice + 1000 else l_extendedprice end::double as l_extendedprice
           from lineitem where l_orderkey % 43 <> 11),
     u as (select 'l_quantity' as col, l_quantity as x from t union all select 'l_extendedprice', l_extendedprice from t)
select col, count(x)::bigint as count, round(avg(x), 4) as mean, round(stddev_samp(x), 4) as stddev, min(x) as min, max(x) as max
from u group by col
""")
def shard_state_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """A2/A3: states of all 43 shards; then shard 6 changes and shard 11 empties, and only those two are read again."""
    li = table(spark, sf, "lineitem").select(lineitem_key().alias("key"), F.col("l_quantity").cast("double").alias("l_quantity"),
                                             F.col("l_extendedprice").cast("double").alias("l_extendedprice"))
    path, cols = scratch_path(spark, f"states/{uuid.uuid4().hex}"), ["l_quantity", "l_extendedprice"]
    shard_state.build(li, path, "key", cols)
    price = F.when(F.col("key") == 6, F.col("l_extendedprice") + 1000).otherwise(F.col("l_extendedprice"))
    shard_state.refresh(li.withColumn("l_extendedprice", price).where("key <> 11"), path, "key", cols, [6, 11])
    return shard_state.summary(spark, path).select("col", "count", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "min", "max")


# ============================================================ clustered layout

def _clustered_lines(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, f"clustered/{uuid.uuid4().hex}")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"),
                                             F.col("l_extendedprice").cast("double").alias("l_extendedprice"), "l_returnflag")
    clustered.write(li, path, ["l_quantity", "l_extendedprice"], zones=["l_orderkey"], bloom=["l_returnflag"], files=32)
    return path


_NARROW = [("l_quantity", ">=", 10.0), ("l_quantity", "<=", 12.0), ("l_returnflag", "in", ["A", "R"])]


@query("clustered_count", """
select count(*) as n, round(sum(l_extendedprice::double), 2) as price from lineitem
where l_quantity between 10 and 12 and l_returnflag in ('A', 'R')
""")
def clustered_count(spark: SparkSession, sf: str) -> DataFrame:
    """A5 + F9: a count and a sum over a narrow range of the clustered lines, from the files that hold it."""
    rows = clustered.read(spark, _clustered_lines(spark, sf), _NARROW)
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("clustered_share", "select count(*) as rows, 32::bigint as files, true as holds_all, true as under_a_quarter from lineitem")
def clustered_share(spark: SparkSession, sf: str) -> DataFrame:
    """S3: the same range opens less than a quarter of the rows, and all that match are in the opened files."""
    path = _clustered_lines(spark, sf)
    matching = clustered.read(spark, path, _NARROW).agg(F.count("*").alias("n"))
    share = clustered.read_share(spark, path, _NARROW)
    n = matching.first()["n"]
    return share.select("rows", "files", (F.col("rows_in_files") >= n).alias("holds_all"),
                        (4 * F.col("rows_in_files") < F.col("rows")).alias("under_a_quarter"))


@query("clustered_present", """
select event_id, value from (select event_id, case when event_id % 17 = 0 then null else value end as value from events)
where value is not null and value > 90
""")
def clustered_present(spark: SparkSession, sf: str) -> DataFrame:
    """F1 + F8: events with gaps, clustered by value; the present ones above a score."""
    path = scratch_path(spark, f"clustered/{uuid.uuid4().hex}")
    clustered.write(table(spark, sf, "events").select("event_id", events_with_gaps().alias("value")), path, ["value"], files=16)
    return clustered.read(spark, path, [("value", "present", None), ("value", ">", 90.0)])
