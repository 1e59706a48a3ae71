"""Driver queries: one per operator family of SURVEY §2, each with its DuckDB twin.

Every query reads the driver's whole tables (no id subsets, no row caps
except where a limit *is* the operator) and returns a DataFrame whose
column names match its SQL twin.  Doubles that come out of sums are
rounded on both sides, since the two engines add in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evstat.functions import exprs as X
from evstat.operators import describe, histogram, metrics, prep
from evstat.operators.quantiles import exact_quantiles
from evstat.plans.tables import (CODE_SQL, COUNTRY_SQL, GAPS_SQL, code_col, country_col,
                                 events_with_gaps, lineitem_key, table)
from evstat.session import reliable_checkpoint, scratch_path
from evstat.sources import io

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return wrap


# ============================================================ minimum slice (entry)

PREPARED_MOMENTS_SQL = f"""
with prepared as (
  select coalesce({CODE_SQL}, {COUNTRY_SQL}) as Actor1Code,
         case when l_extendedprice < 5000 then 1 when l_extendedprice < 20000 then 2
              when l_extendedprice < 40000 then 3 when l_extendedprice < 70000 then 4
              when l_extendedprice < 100000 then 5 else -1 end as tone,
         coalesce({CODE_SQL} = {COUNTRY_SQL}, false) as is_same,
         (l_quantity + 10) / 20 as scale
  from lineitem
  where l_linestatus is not null and l_quantity is not null
)
select Actor1Code, tone, is_same, count(*) as n,
       round(avg(scale), 9) as avg_scale, round(var_samp(scale), 9) as var_scale,
       round(stddev_samp(scale), 9) as sd_scale
from prepared group by Actor1Code, tone, is_same
"""


@query("prepared_moments", PREPARED_MOMENTS_SQL)
def prepared_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Read -> presence filter -> one withColumns (E1 E5 E7 E8) -> A1."""
    li = table(spark, sf, "lineitem")
    base = li.select(code_col().alias("Actor1Code"), country_col().alias("Actor1CountryCode"),
                     "l_extendedprice", "l_quantity", "l_linestatus")
    base = prep.keep_present(base, ["l_linestatus", "l_quantity"])
    fields = prep.add_fields(base, {
        "Actor1Code": X.fill_from("Actor1Code", "Actor1CountryCode"),
        "tone": X.bin_ordinal("l_extendedprice", [5000, 20000, 40000, 70000, 100000]),
        "is_same": X.same_flag("Actor1Code", "Actor1CountryCode"),
        "scale": X.rescale("l_quantity", 10, 20),
    })
    m = describe.grouped_moments(fields, ["Actor1Code", "tone", "is_same"],
                                 {"scale": ["mean", "var_samp", "stddev_samp"]},
                                 names={("scale", "mean"): "avg_scale",
                                        ("scale", "var_samp"): "var_scale",
                                        ("scale", "stddev_samp"): "sd_scale"})
    return m.select("Actor1Code", "tone", "is_same", "n",
                    *[F.round(c, 9).alias(c) for c in ("avg_scale", "var_scale", "sd_scale")])


# ============================================================ sources

@query("scan_delimited", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def scan_delimited(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + S7: write a table as headerless TSV, read it back with a fixed schema."""
    src = table(spark, sf, "customer")
    path = scratch_path(spark, f"scan_delimited/{uuid.uuid4().hex}")
    io.write_delimited(src, path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in src.schema.fields])
    return io.read_delimited(spark, path, schema)


@query("declared_schema", f"""
select cast(l_orderkey as varchar) as _id,
       cast(case when l_quantity <= 25 then 0 else 1 end as tinyint) as label,
       cast(l_orderkey % 43 as tinyint) as key,
       (l_quantity + 10) / 20 as GoldsteinScale,
       {COUNTRY_SQL} as Actor1CountryCode,
       coalesce({CODE_SQL}, {COUNTRY_SQL}) as Actor1Code,
       coalesce(nullif(l_linestatus, 'F'), '') as Actor2Code,
       l_extendedprice as AvgTone
from lineitem
""")
def declared_schema(spark: SparkSession, sf: str) -> DataFrame:
    """S4 + E11 + E12: project to a declared 8-field schema with casts."""
    li = table(spark, sf, "lineitem")
    prepared = li.select(
        F.col("l_orderkey").alias("_id"),
        X.label_binary("l_quantity", 25).alias("label"),
        lineitem_key().alias("key"),
        X.rescale("l_quantity", 10, 20).alias("GoldsteinScale"),
        country_col().alias("Actor1CountryCode"),
        X.fill_from(code_col(), country_col()).alias("Actor1Code"),
        X.fill_literal(F.nullif(F.col("l_linestatus"), F.lit("F")), "").alias("Actor2Code"),
        F.col("l_extendedprice").alias("AvgTone"))
    schema = T.StructType([
        T.StructField("_id", T.StringType()), T.StructField("label", T.ByteType()),
        T.StructField("key", T.ByteType()), T.StructField("GoldsteinScale", T.DoubleType()),
        T.StructField("Actor1CountryCode", T.StringType()), T.StructField("Actor1Code", T.StringType()),
        T.StructField("Actor2Code", T.StringType()), T.StructField("AvgTone", T.DoubleType())])
    return prep.to_declared_schema(prepared, schema)


@query("ordered_limit", """
select o_orderkey, o_custkey, o_totalprice, o_orderpriority
from orders order by o_totalprice desc, o_orderkey limit 100
""")
def ordered_limit(spark: SparkSession, sf: str) -> DataFrame:
    """F11 + S15: a top-100 report (the limit is the operator)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return prep.ordered_limit(o, 100, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("sql_view_cast", """
select l_orderkey, l_linenumber, tone, cast(tone as tinyint) as label
from (select l_orderkey, l_linenumber,
             case when l_extendedprice < 5000 then 1 when l_extendedprice < 20000 then 2
                  when l_extendedprice < 40000 then 3 when l_extendedprice < 70000 then 4
                  when l_extendedprice < 100000 then 5 else -1 end as tone
      from lineitem) t
where tone > 0
""")
def sql_view_cast(spark: SparkSession, sf: str) -> DataFrame:
    """S13 + P7 + F8 + E12: temp view queried with SQL, ``select *, cast(...)``."""
    li = table(spark, sf, "lineitem")
    t = li.select("l_orderkey", "l_linenumber",
                  X.bin_ordinal("l_extendedprice", [5000, 20000, 40000, 70000, 100000]).alias("tone"))
    view = f"tones_{uuid.uuid4().hex[:8]}"
    io.register_view(t, view)
    return spark.sql(f"select *, cast(tone as tinyint) as label from {view} where tone > 0")


# ============================================================ filters

@query("filter_present_shards", f"""
select l_orderkey, l_linenumber, l_quantity, {CODE_SQL} as Actor1Code, l_orderkey % 43 as key
from lineitem
where {CODE_SQL} is not null and l_orderkey % 43 in (3, 5, 7, 8)
""")
def filter_present_shards(spark: SparkSession, sf: str) -> DataFrame:
    """F1 + F3 + F12: presence of a nullable code and a shard list."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", code_col().alias("Actor1Code"),
        lineitem_key().alias("key"))
    return prep.in_shards(prep.keep_present(li, ["Actor1Code"]), [3, 5, 7, 8])


@query("shards_below", """
select l_orderkey % 43 as key, count(*) as n from lineitem where l_orderkey % 43 < 8 group by 1
""")
def shards_below(spark: SparkSession, sf: str) -> DataFrame:
    """the shards below a threshold, rows per shard."""
    li = table(spark, sf, "lineitem").select(lineitem_key().alias("key"))
    return prep.shards_below(li, 8).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("exclude_category", """
select l_orderkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice
from lineitem
where l_returnflag <> 'N' and l_quantity is not null and l_extendedprice is not null
""")
def exclude_category(spark: SparkSession, sf: str) -> DataFrame:
    """F6 + F9: drop the dominant category and rows missing either measure."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    li = prep.keep_present(li, ["l_quantity", "l_extendedprice"])
    return prep.not_equal(li, "l_returnflag", "N")


@query("keep_nonempty_text", """
select o_orderkey, nullif(o_orderstatus, 'P') as status
from orders
where nullif(o_orderstatus, 'P') is not null and nullif(o_orderstatus, 'P') <> ''
  and o_totalprice is not null
""")
def keep_nonempty_text(spark: SparkSession, sf: str) -> DataFrame:
    """present and non-empty text; the numeric column only gets the null test."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), "o_totalprice")
    return prep.keep_nonempty(o, ["status", "o_totalprice"]).select("o_orderkey", "status")


@query("keep_null_not_equal", """
select event_id, tone from (
  select event_id, case when event_id % 17 = 0 then null
                        when value < 10 then 0 else 1 end as tone from events) t
where tone <> 0 or tone is null
""")
def keep_null_not_equal(spark: SparkSession, sf: str) -> DataFrame:
    """store-style ``$ne`` keeps rows whose value is missing."""
    ev = table(spark, sf, "events").select(
        "event_id",
        F.when(F.pmod("event_id", F.lit(17)) == 0, F.lit(None).cast("int"))
        .when(F.col("value") < 10, F.lit(0)).otherwise(F.lit(1)).alias("tone"))
    return prep.not_equal_keep_null(ev, "tone", 0)


@query("hash_split", """
select case when l_orderkey % 10 = 0 then 'test' else 'train' end as part, count(*) as n
from lineitem group by 1
""")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    """F13 (deterministic form): 1:9 split by a hash of the id, sizes per part."""
    li = table(spark, sf, "lineitem").select("l_orderkey")
    return prep.hash_split(li, "l_orderkey", 1, 10, exact=True).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"))


@query("shard_split", """
select case when l_orderkey % 43 = 6 then 'test' else 'train' end as part,
       count(*) as n, round(avg(l_quantity), 9) as avg_qty
from lineitem where l_orderkey % 43 in (2, 20, 6) group by 1
""")
def shard_split(spark: SparkSession, sf: str) -> DataFrame:
    """F14 + F4: training shards 2 and 20, test shard 6, tagged in one scan."""
    li = table(spark, sf, "lineitem").select("l_quantity", lineitem_key().alias("key"))
    out = prep.label_shards(li, {"train": [2, 20], "test": [6]})
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"),
                                   F.round(F.avg("l_quantity"), 9).alias("avg_qty"))


# ============================================================ expressions

@query("fill_and_flag", f"""
select l_orderkey, l_linenumber,
       coalesce({CODE_SQL}, {COUNTRY_SQL}) as Actor1Code,
       {COUNTRY_SQL} as Actor1CountryCode,
       coalesce(nullif(l_linestatus, 'F'), '') as Actor2Code,
       coalesce({CODE_SQL} = {COUNTRY_SQL}, false) as is_same,
       l_quantity as scale
from lineitem
""")
def fill_and_flag(spark: SparkSession, sf: str) -> DataFrame:
    """P5 + P6 + E1 + E2 + E7: every field from the input row (trap T4)."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", code_col().alias("Actor1Code"),
        country_col().alias("Actor1CountryCode"),
        F.nullif(F.col("l_linestatus"), F.lit("F")).alias("Actor2Code"), "l_quantity")
    out = prep.add_fields(li, {
        "Actor1Code": X.fill_from("Actor1Code", "Actor1CountryCode"),
        "Actor2Code": X.fill_literal("Actor2Code", ""),
        "is_same": X.same_flag("Actor1Code", "Actor1CountryCode"),
        "scale": F.col("l_quantity"),
    })
    return out.drop("l_quantity")


ORDINAL_CUTS = [10.0, 25.0, 50.0, 100.0, 500.0]


@query("bin_ordinal", f"""
select event_id,
       case when x is null then 1 when x < 10 then 1 when x < 25 then 2 when x < 50 then 3
            when x < 100 then 4 when x < 500 then 5 else -1 end as tone,
       case when x is null then -1 when x < 10 then 1 when x < 25 then 2 when x < 50 then 3
            when x < 100 then 4 when x < 500 then 5 else -1 end as tone_default,
       case when x is null then null when x < 10 then 1 when x < 25 then 2 when x < 50 then 3
            when x < 100 then 4 when x < 500 then 5 else -1 end as tone_null
from (select event_id, {GAPS_SQL} as x from events) t
""")
def bin_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    """E5 with each null policy (trap T1)."""
    ev = table(spark, sf, "events").select("event_id", events_with_gaps().alias("x"))
    return ev.select("event_id",
                     X.bin_ordinal("x", ORDINAL_CUTS, nulls="lowest").alias("tone"),
                     X.bin_ordinal("x", ORDINAL_CUTS, nulls="default").alias("tone_default"),
                     X.bin_ordinal("x", ORDINAL_CUTS, nulls="null").alias("tone_null"))


@query("bin_three_way", f"""
select event_id,
       case when x >= 100 then 'positive' when x <= 10 or x is null then 'negative'
            else 'neutral' end as ToneLevel
from (select event_id, {GAPS_SQL} as x from events) t
""")
def bin_three_way(spark: SparkSession, sf: str) -> DataFrame:
    """Two cuts, nulls lowest."""
    ev = table(spark, sf, "events").select("event_id", events_with_gaps().alias("x"))
    return ev.select("event_id", X.bin_three_way("x", 100.0, 10.0).alias("ToneLevel"))


@query("bin_two_way", f"""
select event_id,
       case when x is null then 'invalid' when x >= 50 then 'positive'
            when x < 50 then 'negative' else 'invalid' end as ToneLevel
from (select event_id, {GAPS_SQL} as x from events) t
""")
def bin_two_way(spark: SparkSession, sf: str) -> DataFrame:
    """One cut, nulls to the default label."""
    ev = table(spark, sf, "events").select("event_id", events_with_gaps().alias("x"))
    return ev.select("event_id", X.bin_two_way("x", 50.0, nulls="default").alias("ToneLevel"))


@query("label_binary", f"""
select event_id, case when x <= 25 or x is null then 0 else 1 end as label
from (select event_id, {GAPS_SQL} as x from events) t
""")
def label_binary(spark: SparkSession, sf: str) -> DataFrame:
    """``<= cut`` gives 0, else 1; nulls lowest."""
    ev = table(spark, sf, "events").select("event_id", events_with_gaps().alias("x"))
    return ev.select("event_id", X.label_binary("x", 25.0).alias("label"))


@query("bin_quantile", """
with q as (select quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.75) as q75 from events)
select event_id,
       case when value >= q75 then 'positive' when value <= q25 then 'negative'
            else 'neutral' end as ToneLevel
from events, q
""")
def bin_quantile(spark: SparkSession, sf: str) -> DataFrame:
    """Cuts from exact quartiles of an earlier pass, then E3."""
    ev = table(spark, sf, "events").select("event_id", "value")
    q25, q75 = exact_quantiles(ev, "value", [0.25, 0.75])
    return ev.select("event_id", X.bin_three_way("value", q75, q25).alias("ToneLevel"))


@query("rescale", """
select l_orderkey, l_linenumber,
       round((l_quantity + 10) / 20, 12) as scale01,
       round((l_extendedprice + 20) / 40, 9) as tone01
from lineitem
""")
def rescale(spark: SparkSession, sf: str) -> DataFrame:
    """``(x + 10) / 20`` and ``(x + 20) / 40``."""
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.round(X.rescale("l_quantity", 10, 20), 12).alias("scale01"),
                     F.round(X.rescale("l_extendedprice", 20, 40), 9).alias("tone01"))


@query("round_half_even_text", """
select l_orderkey, l_linenumber, l_quantity / 2 as half,
       round_even(l_quantity / 2, 0) as rounded,
       cast(cast(round_even(l_quantity / 2, 0) as bigint) as varchar) as rounded_text,
       cast(l_orderkey as varchar) as id_text
from lineitem
""")
def round_half_even_text(spark: SparkSession, sf: str) -> DataFrame:
    """E9 + E10 + E11: banker's rounding, whole number to text, id to text."""
    li = table(spark, sf, "lineitem")
    half = F.col("l_quantity") / 2
    return li.select("l_orderkey", "l_linenumber", half.alias("half"),
                     X.round_half_even(half).alias("rounded"),
                     X.number_to_text(X.round_half_even(half)).alias("rounded_text"),
                     X.to_text("l_orderkey").alias("id_text"))


@query("mean_cut", """
with m as (select avg(l_extendedprice) as mean_price from lineitem)
select l_orderkey, l_linenumber,
       case when l_extendedprice >= mean_price then 'positive'
            when l_extendedprice < mean_price then 'negative' else 'invalid' end as ToneLevel
from lineitem, m
""")
def mean_cut(spark: SparkSession, sf: str) -> DataFrame:
    """E4 + E15: two-way bin around the mean of an earlier pass (scalar subquery)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    li = prep.with_mean_cut(li, "l_extendedprice", "mean_price")
    level = X.bin_two_way("l_extendedprice", F.col("mean_price"))
    return li.select("l_orderkey", "l_linenumber", level.alias("ToneLevel"))


@query("mean_cut_gaps", f"""
with g as (select event_id, {GAPS_SQL} as v from events), m as (select avg(v) as mean_value from g)
select event_id, case when v >= mean_value then 'positive' else 'negative' end as ToneLevel from g, m
""")
def mean_cut_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """E4 + E15 on a measure with nulls: a missing value sorts below every cut (trap T1)."""
    ev = table(spark, sf, "events").select("event_id", events_with_gaps().alias("v"))
    ev = prep.with_mean_cut(ev, "v", "mean_value")
    return ev.select("event_id", X.bin_two_way("v", F.col("mean_value")).alias("ToneLevel"))


@query("returned_lines", """
select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'R'
""")
def returned_lines(spark: SparkSession, sf: str) -> DataFrame:
    """F5 + P3: keep one category, then drop its column."""
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    kept = prep.equals(table(spark, sf, "lineitem"), "l_returnflag", "R")
    return prep.project(kept, cols, exclude=["l_returnflag"])


# ============================================================ aggregates

@query("grouped_moments", """
select l_returnflag,
       round(avg(l_extendedprice), 4) as avg_tone, count(*) as n,
       round(var_samp(l_extendedprice), 0) as var_tone, round(stddev_samp(l_extendedprice), 4) as sd_tone,
       round(avg(l_quantity), 9) as avg_scale, round(var_samp(l_quantity), 7) as var_scale,
       round(stddev_samp(l_quantity), 9) as sd_scale
from lineitem group by l_returnflag
""")
def grouped_moments(spark: SparkSession, sf: str) -> DataFrame:
    """A1: mean, count, sample variance and stddev of two measures per category."""
    li = table(spark, sf, "lineitem")
    m = describe.grouped_moments(
        li, "l_returnflag",
        {"l_extendedprice": ["mean", "var_samp", "stddev_samp"],
         "l_quantity": ["mean", "var_samp", "stddev_samp"]},
        names={("l_extendedprice", "mean"): "avg_tone", ("l_extendedprice", "var_samp"): "var_tone",
               ("l_extendedprice", "stddev_samp"): "sd_tone", ("l_quantity", "mean"): "avg_scale",
               ("l_quantity", "var_samp"): "var_scale", ("l_quantity", "stddev_samp"): "sd_scale"})
    return m.select("l_returnflag", F.round("avg_tone", 4).alias("avg_tone"), "n",
                    F.round("var_tone", 0).alias("var_tone"), F.round("sd_tone", 4).alias("sd_tone"),
                    F.round("avg_scale", 9).alias("avg_scale"), F.round("var_scale", 7).alias("var_scale"),
                    F.round("sd_scale", 9).alias("sd_scale"))


@query("shard_summary", """
select l_orderkey % 43 as _id, count(*) as count,
       round(avg(l_extendedprice), 4) as avg_tone, round(stddev_pop(l_extendedprice), 4) as sd_tone,
       round(avg(l_quantity), 9) as avg_scale, round(stddev_pop(l_quantity), 9) as sd_scale
from lineitem
where l_linestatus is not null and l_quantity is not null and l_extendedprice is not null
group by 1
""")
def shard_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A2: per shard count, mean and population stddev of two measures."""
    li = table(spark, sf, "lineitem").select(
        "l_linestatus", F.col("l_extendedprice").alias("AvgTone"),
        F.col("l_quantity").alias("GoldsteinScale"), lineitem_key().alias("key"))
    li = prep.keep_present(li, ["l_linestatus", "GoldsteinScale", "AvgTone"])
    s = describe.shard_summary(li)
    return s.select("_id", "count", F.round("avg_tone", 4).alias("avg_tone"),
                    F.round("sd_tone", 4).alias("sd_tone"), F.round("avg_scale", 9).alias("avg_scale"),
                    F.round("sd_scale", 9).alias("sd_scale"))


def _summary_sql(stats: list[tuple[str, str]]) -> str:
    parts = []
    for label, fn in stats:
        cells = ", ".join(
            f"round({fn.format(x=x)}, {nd}) as {name}"
            for name, x, nd in (("value", "value", 6), ("user_id", "cast(user_id as double)", 6),
                                ("event_type", "try_cast(event_type as double)", 6)))
        parts.append(f"select '{label}' as summary, {cells} from events")
    return "\nunion all\n".join(parts)


_COUNT = "cast(count({x}) as double)"
SUMMARY_SELECTED = [("count", _COUNT), ("mean", "avg({x})"), ("stddev", "stddev_samp({x})"),
                    ("25%", "quantile_cont({x}, 0.25)"), ("75%", "quantile_cont({x}, 0.75)")]
SUMMARY_FULL = [("count", _COUNT), ("mean", "avg({x})"), ("stddev", "stddev_samp({x})"),
                ("min", "min({x})"), ("25%", "quantile_cont({x}, 0.25)"),
                ("50%", "quantile_cont({x}, 0.5)"), ("75%", "quantile_cont({x}, 0.75)"),
                ("max", "max({x})")]


def _rounded_summary(df: DataFrame, stats: list[str]) -> DataFrame:
    s = describe.summary_exact(df, ["value", "user_id", "event_type"], stats)
    return s.select("summary", *[F.round(c, 6).alias(c) for c in ("value", "user_id", "event_type")])


def _count_fix(sql: str) -> str:
    # count() of a text column counts non-null cells, not numeric ones
    return sql.replace("cast(count(try_cast(event_type as double)) as double)",
                       "cast(count(event_type) as double)")


@query("summary_selected", _count_fix(_summary_sql(SUMMARY_SELECTED)))
def summary_selected(spark: SparkSession, sf: str) -> DataFrame:
    """A3: count, mean, stddev, 25 %, 75 % of numeric and text columns, exact percentiles."""
    ev = table(spark, sf, "events")
    return _rounded_summary(ev, ["count", "mean", "stddev", "25%", "75%"])


@query("summary_full", _count_fix(_summary_sql(SUMMARY_FULL)))
def summary_full(spark: SparkSession, sf: str) -> DataFrame:
    """A4: the full eight-statistic summary, exact percentiles."""
    ev = table(spark, sf, "events")
    return _rounded_summary(ev, list(describe.SUMMARY_ALL))


@query("filtered_count", """
select count(*) as n from lineitem where l_quantity >= 10 and l_returnflag <> 'N'
""")
def filtered_count(spark: SparkSession, sf: str) -> DataFrame:
    """A5: global count under a filter."""
    li = table(spark, sf, "lineitem")
    return describe.filtered_count(li, (F.col("l_quantity") >= 10) & (F.col("l_returnflag") != "N"))


def _hist_sql(source: str, lo: float, step_inv: int, nbins: int, column: str | None = None) -> str:
    """Histogram SQL for edges ``lo + i/step_inv`` (steps exact in binary)."""
    hi = lo + nbins / step_inv
    col_sel = f"'{column}' as column, " if column else ""
    return f"""
select {col_sel}s.bin_start, coalesce(c.n, 0) as n
from (select range as bin, {lo} + range / {step_inv}.0 as bin_start from range(0, {nbins})) s
left join (
  select case when x = {hi} then {nbins - 1} else cast(floor((x - ({lo})) * {step_inv}) as bigint) end as bin,
         count(*) as n
  from ({source}) t
  where x is not null and not isnan(x) and x >= {lo} and x <= {hi}
  group by 1) c on s.bin = c.bin
"""


@query("histogram_shared", "\nunion all\n".join([
    _hist_sql("select l_extendedprice / 2000 - 20 as x from lineitem", -15.0, 8, 247, "tone"),
    _hist_sql("select l_quantity - 25 as x from lineitem", -15.0, 8, 247, "scale"),
]))
def histogram_shared(spark: SparkSession, sf: str) -> DataFrame:
    """A6 + A8: two columns on the shared 1/8-step axis in one scan, empty bins kept."""
    li = table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / 2000 - 20).alias("tone"), (F.col("l_quantity") - 25).alias("scale"))
    return histogram.histograms(li, ["tone", "scale"], histogram.SHARED_EDGES)


@query("histogram_half", _hist_sql("select value / 10 - 10 as x from events", -10.0, 2, 61))
def histogram_half(spark: SparkSession, sf: str) -> DataFrame:
    """A7 + A8: one column on half-unit edges -10 .. 20.5."""
    ev = table(spark, sf, "events").select((F.col("value") / 10 - 10).alias("x"))
    return histogram.histogram(ev, "x", histogram.HALF_EDGES)


# ============================================================ metrics

_REG_PRED = "2000 * l_quantity"


@query("regression_metrics", f"""
with p as (select l_extendedprice as label, {_REG_PRED} as prediction from lineitem),
     m as (select avg(label) as mu from p)
select count(*) as n,
       round(sqrt(avg((prediction - label) * (prediction - label))), 6) as rmse,
       round(avg((prediction - label) * (prediction - label)), 2) as mse,
       round(avg(abs(prediction - label)), 6) as mae,
       round(1 - sum((prediction - label) * (prediction - label)) / sum((label - mu) * (label - mu)), 9) as r2,
       round(avg((prediction - mu) * (prediction - mu)), 2) as explained_variance,
       count(*) - 1 - 1 as dof
from p, m
""")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """V1-V3 + V14: RMSE, MSE, MAE, R^2, explained variance, residual dof."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.lit(2000.0) * F.col("l_quantity")).alias("prediction"))
    m = metrics.regression_metrics(li, num_features=1)
    return m.select("n", F.round("rmse", 6).alias("rmse"), F.round("mse", 2).alias("mse"),
                    F.round("mae", 6).alias("mae"), F.round("r2", 9).alias("r2"),
                    F.round("explained_variance", 2).alias("explained_variance"), "dof")


@query("residuals", f"""
select l_orderkey, l_linenumber, round(l_extendedprice - {_REG_PRED}, 6) as residual from lineitem
""")
def residuals(spark: SparkSession, sf: str) -> DataFrame:
    """``label - prediction`` per row."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("label"),
        (F.lit(2000.0) * F.col("l_quantity")).alias("prediction"))
    r = metrics.residuals(li)
    return r.select("l_orderkey", "l_linenumber", F.round("residual", 6).alias("residual"))


_CLS_LABEL = "cast(case when l_quantity <= 15 then 0 when l_quantity <= 35 then 1 else 2 end as double)"
_CLS_PRED = "cast(case when l_discount > 0.05 then 1 else 0 end as double)"


def _cls_frame(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.expr(_CLS_LABEL).alias("label"), F.expr(_CLS_PRED).alias("prediction"))


_CONFUSION_SQL = f"""
with p as (select {_CLS_LABEL} as label, {_CLS_PRED} as prediction from lineitem),
     tot as (select count(*) as total from p),
     cls as (select label as c from p union select prediction from p),
     per as (
       select c as label,
              (select count(*) from p where p.label = cls.c) as support,
              (select count(*) from p where p.label = cls.c and p.prediction = cls.c) as tp,
              (select count(*) from p where p.prediction = cls.c) as predicted
       from cls),
     rates as (
       select label, support, tp, predicted - tp as fp, support - tp as fn,
              total - support - predicted + tp as tn,
              coalesce(cast(tp as double) / nullif(predicted, 0), 0.0) as precision,
              coalesce(cast(tp as double) / nullif(support, 0), 0.0) as recall,
              coalesce(cast(predicted - tp as double) / nullif(total - support, 0), 0.0) as fpr,
              total
       from per, tot)
"""


@query("classification_by_label", _CONFUSION_SQL + """
select label, support, tp, fp, fn, tn,
       round(fpr, 12) as false_positive_rate, round(recall, 12) as true_positive_rate,
       round(precision, 12) as precision, round(recall, 12) as recall,
       round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 12) as f_measure
from rates
""")
def classification_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """V5-V9: per-label FPR, TPR, precision, recall, F1 (a never-predicted label included)."""
    per = metrics.per_label_metrics(_cls_frame(spark, sf))
    return per.select("label", "support", "tp", "fp", "fn", "tn",
                      *[F.round(c, 12).alias(c) for c in
                        ("false_positive_rate", "true_positive_rate", "precision", "recall", "f_measure")])


@query("classification_weighted", _CONFUSION_SQL + """
select round(sum(tp) * 1.0 / sum(support), 12) as accuracy,
       round(sum(support * 1.0 / total * fpr), 12) as weighted_false_positive_rate,
       round(sum(support * 1.0 / total * recall), 12) as weighted_true_positive_rate,
       round(sum(support * 1.0 / total *
                 coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0)), 12) as weighted_f_measure,
       round(sum(support * 1.0 / total * precision), 12) as weighted_precision,
       round(sum(support * 1.0 / total * recall), 12) as weighted_recall
from rates
""")
def classification_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """V4 + V10: accuracy and label-share weighted rates."""
    w = metrics.weighted_metrics(_cls_frame(spark, sf))
    return w.select(*[F.round(c, 12).alias(c) for c in w.columns])


@query("classification_accuracy", f"""
select round(avg(case when ({_CLS_LABEL}) = ({_CLS_PRED}) then 1.0 else 0.0 end), 12) as accuracy
from lineitem
""")
def classification_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """V4 alone: one aggregate."""
    a = metrics.accuracy(_cls_frame(spark, sf))
    return a.select(F.round("accuracy", 12).alias("accuracy"))


# ============================================================ the event file layout

_EVENT_MAP = {
    "GlobalEventId": ("cast(event_id as int)", "cast(event_id as integer)"),
    "Day": ("cast(date_format(ts, 'yyyyMMdd') as int)", "cast(strftime(ts, '%Y%m%d') as integer)"),
    "MonthYear": ("cast(date_format(ts, 'yyyyMM') as int)", "cast(strftime(ts, '%Y%m') as integer)"),
    "Year": ("year(ts)", "cast(year(ts) as integer)"),
    "EventCode": ("event_type", "event_type"),
    "NumMentions": ("cast(user_id as int)", "cast(user_id as integer)"),
    "AvgTone": ("value", "value"),
}
_EVENT_OUT = ["GlobalEventId", "Day", "MonthYear", "Year", "EventCode", "NumMentions", "AvgTone",
              "GoldsteinScale", "SOURCEURL"]


def _event_sql() -> str:
    cols = []
    for c in _EVENT_OUT:
        if c in _EVENT_MAP:
            cols.append(f"{_EVENT_MAP[c][1]} as {c}")
        else:
            typ = {"GoldsteinScale": "double", "SOURCEURL": "varchar"}[c]
            cols.append(f"cast(null as {typ}) as {c}")
    return "select " + ", ".join(cols) + " from events"


@query("scan_event_file", _event_sql())
def scan_event_file(spark: SparkSession, sf: str) -> DataFrame:
    """S1 on the real layout: rows laid out in the 61 tab-separated fields
    (unmapped fields empty), read back with the fixed event schema; the
    projection prunes the other columns from the scan."""
    ev = table(spark, sf, "events")
    fields = [F.expr(_EVENT_MAP[f.name][0]).cast(f.dataType).alias(f.name) if f.name in _EVENT_MAP
              else F.lit(None).cast(f.dataType).alias(f.name) for f in io.EVENT_SCHEMA.fields]
    path = scratch_path(spark, f"event_file/{uuid.uuid4().hex}")
    io.write_delimited(ev.select(*fields), path)
    return io.read_delimited(spark, path).select(*_EVENT_OUT)


# ============================================================ the import job as one flow

TONE_FLOW_SQL = f"""
with q as (select quantile_cont(l_extendedprice, 0.25) as q25, quantile_cont(l_extendedprice, 0.75) as q75
           from lineitem where l_linestatus is not null and l_quantity is not null),
prepared as (
  select l_orderkey, l_linenumber, l_extendedprice as AvgTone, l_quantity as GoldsteinScale,
         l_quantity as scale,
         coalesce({CODE_SQL}, {COUNTRY_SQL}) as Actor1Code,
         coalesce({CODE_SQL} = {COUNTRY_SQL}, false) as is_same,
         case when l_extendedprice >= q75 then 'positive' when l_extendedprice <= q25 then 'negative'
              else 'neutral' end as ToneLevel
  from lineitem, q
  where l_linestatus is not null and l_quantity is not null),
kept as (select * from prepared)
select 'count' as summary, round(cast(count(AvgTone) as double), 6) as AvgTone,
       round(cast(count(GoldsteinScale) as double), 6) as GoldsteinScale,
       round(cast(count(is_same) as double), 6) as is_same,
       round(cast(count(ToneLevel) as double), 6) as ToneLevel from kept
union all select 'mean', round(avg(AvgTone), 6), round(avg(GoldsteinScale), 6),
       round(avg(cast(is_same as int)), 6), round(avg(try_cast(ToneLevel as double)), 6) from kept
union all select 'stddev', round(stddev_samp(AvgTone), 6), round(stddev_samp(GoldsteinScale), 6),
       round(stddev_samp(cast(is_same as int)), 6), round(stddev_samp(try_cast(ToneLevel as double)), 6) from kept
union all select '25%', round(quantile_cont(AvgTone, 0.25), 6), round(quantile_cont(GoldsteinScale, 0.25), 6),
       round(quantile_cont(cast(is_same as int), 0.25), 6),
       round(quantile_cont(try_cast(ToneLevel as double), 0.25), 6) from kept
union all select '75%', round(quantile_cont(AvgTone, 0.75), 6), round(quantile_cont(GoldsteinScale, 0.75), 6),
       round(quantile_cont(cast(is_same as int), 0.75), 6),
       round(quantile_cont(try_cast(ToneLevel as double), 0.75), 6) from kept
"""


@query("tone_level_summary", TONE_FLOW_SQL)
def tone_level_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The import job end to end: presence filter, one ``withColumns`` of fill,
    flag and a three-way tone level whose cuts are exact quartiles of an
    earlier pass, then the selected summary of all rows."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_linestatus",
        code_col().alias("Actor1Code"), country_col().alias("Actor1CountryCode"))
    li = reliable_checkpoint(prep.keep_present(li, ["l_linestatus", "l_quantity"]))    # read by several passes
    q25, q75 = exact_quantiles(li, "l_extendedprice", [0.25, 0.75])
    fields = prep.add_fields(li, {
        "AvgTone": F.col("l_extendedprice"),
        "GoldsteinScale": F.col("l_quantity"),
        "scale": F.col("l_quantity"),
        "Actor1Code": X.fill_from("Actor1Code", "Actor1CountryCode"),
        "is_same": X.same_flag("Actor1Code", "Actor1CountryCode"),
        "ToneLevel": X.bin_three_way("l_extendedprice", q75, q25),
    })
    # the rows are read by several summary passes: write them once to the
    # checkpoint folder instead of reading and preparing them per pass
    kept = reliable_checkpoint(fields.select("AvgTone", "GoldsteinScale", "is_same", "ToneLevel"))
    cols = ("AvgTone", "GoldsteinScale", "is_same", "ToneLevel")
    s = describe.summary_exact(kept, list(cols), ["count", "mean", "stddev", "25%", "75%"])
    return s.select("summary", *[F.round(c, 6).alias(c) for c in cols])
