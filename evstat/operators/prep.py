"""Filters, sampling, splits, projections.

Everything is a lazy DataFrame transform: Catalyst pushes the filters
into the parquet scan and prunes the columns, so a shard or presence
filter costs nothing beyond the row groups it keeps.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evstat.functions.exprs import ColumnOrName, _col

DEFAULT_SHARDS = 43  # number of shards in the reference's grouped summary


# ---------------------------------------------------------------- presence (F1, F2)

def keep_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Keep rows where every column in ``cols`` is non-null (F1).

    Uses ``isNotNull`` rather than ``dropna``: ``dropna`` also drops NaN,
    which the store's ``$ne: null`` keeps.
    """
    cond = None
    for c in cols:
        term = F.col(c).isNotNull()
        cond = term if cond is None else cond & term
    return df if cond is None else df.where(cond)


def keep_nonempty(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Keep rows where each column is present and, for text columns, not ``''`` (F2).

    The empty-string test only applies to string columns: on numbers it
    is meaningless and, under ANSI, the implicit cast of ``''`` raises.
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    cond = None
    for c in cols:
        term = F.col(c).isNotNull()
        if isinstance(types.get(c), T.StringType):
            term = term & (F.col(c) != F.lit(""))
        cond = term if cond is None else cond & term
    return df if cond is None else df.where(cond)


# ---------------------------------------------------------------- shards

def shard_key(id_col: ColumnOrName, n: int = DEFAULT_SHARDS, exact: bool = False) -> Column:
    """Near-uniform shard number in ``[0, n)``.

    ``exact=False`` hashes the id (xxhash64), robust to any id layout;
    ``exact=True`` uses ``pmod(id, n)`` so a SQL engine can reproduce it.
    """
    c = _col(id_col)
    base = c.cast("bigint") if exact else F.xxhash64(c)
    return F.pmod(base, F.lit(n))


def with_shard(df: DataFrame, id_col: str, n: int = DEFAULT_SHARDS,
               name: str = "key", exact: bool = False) -> DataFrame:
    """Add the shard column ``name`` derived from ``id_col``."""
    return df.withColumn(name, shard_key(id_col, n, exact))


def in_shards(df: DataFrame, shards: Iterable[int], key: str = "key") -> DataFrame:
    """Keep rows whose shard is in ``shards``."""
    return df.where(F.col(key).isin(*[int(s) for s in shards]))


def shards_below(df: DataFrame, n: int, key: str = "key") -> DataFrame:
    """Keep shards ``key < n``."""
    return df.where(F.col(key) < F.lit(n))


# ---------------------------------------------------------------- predicates

def equals(df: DataFrame, col: str, value: Any) -> DataFrame:
    """``col == value``."""
    return df.where(F.col(col) == F.lit(value))


def not_equal(df: DataFrame, col: str, value: Any) -> DataFrame:
    """``col != value``; a null operand drops the row (SQL semantics)."""
    return df.where(F.col(col) != F.lit(value))


def not_equal_keep_null(df: DataFrame, col: str, value: Any) -> DataFrame:
    """``col != value`` where a missing value counts as different (store ``$ne``)."""
    return df.where((F.col(col) != F.lit(value)) | F.col(col).isNull())


def greater_than(df: DataFrame, col: str, value: Any) -> DataFrame:
    """F8: ``col > value``."""
    return df.where(F.col(col) > F.lit(value))


def all_of(df: DataFrame, *conds: Column) -> DataFrame:
    """conjunction of predicates, one filter node for Catalyst to push."""
    cond = None
    for c in conds:
        cond = c if cond is None else cond & c
    return df if cond is None else df.where(cond)


# ---------------------------------------------------------------- limits

def ordered_limit(df: DataFrame, n: int, order: Sequence[ColumnOrName]) -> DataFrame:
    """First ``n`` rows under an explicit order.

    Spark plans this as ``TakeOrderedAndProject``: each partition keeps
    its own top ``n``, so only ``n * partitions`` rows reach the final
    merge, never the whole table.
    """
    if not order:
        raise ValueError("an explicit order is required for a deterministic limit")
    return df.orderBy(*order).limit(int(n))


# ---------------------------------------------------------------- splits

def random_split(df: DataFrame, weights: Sequence[float] = (0.1, 0.9),
                 seed: int = 42) -> list[DataFrame]:
    """Seeded random split (F13); index 0 is the test part in the reference."""
    return df.randomSplit(list(weights), seed=seed)


def hash_split(df: DataFrame, id_col: str, test_fraction_buckets: int = 1,
               buckets: int = 10, exact: bool = False,
               name: str = "part") -> DataFrame:
    """Deterministic split label: ``test`` for the first buckets, else ``train``.

    Stable under re-execution (unlike ``randomSplit`` on a re-read input),
    so a lost executor recomputes the same split.
    """
    b = shard_key(id_col, buckets, exact)
    return df.withColumn(name, F.when(b < F.lit(test_fraction_buckets), F.lit("test"))
                         .otherwise(F.lit("train")))


def shard_split(df: DataFrame, train: Iterable[int], test: Iterable[int],
                key: str = "key") -> tuple[DataFrame, DataFrame]:
    """training and test sets by shard lists."""
    return in_shards(df, train, key), in_shards(df, test, key)


def label_shards(df: DataFrame, parts: Mapping[str, Iterable[int]], key: str = "key",
                 name: str = "part") -> DataFrame:
    """F14 in one pass: tag each row with the part whose shard list holds its
    key (``{"train": [2, 20], "test": [6]}``) and drop rows in no part.
    One scan instead of one per part."""
    expr = None
    keep = []
    for label, shards in parts.items():
        shards = [int(x) for x in shards]
        keep += shards
        cond = F.col(key).isin(*shards)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return df.where(F.col(key).isin(*keep)).withColumn(name, expr)


# ---------------------------------------------------------------- projections

def add_fields(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """P5: add or replace several fields, each computed from the input row.

    One ``withColumns`` call, so a replaced column is never seen by a
    sibling expression (trap T4).
    """
    return df.withColumns(dict(fields))


def project(df: DataFrame, keep: Sequence[str] = (), computed: Mapping[str, Column] | None = None,
            exclude: Sequence[str] = ()) -> DataFrame:
    """Keep named columns, add computed ones, drop excluded ones."""
    cols: list[Column] = [F.col(c) for c in keep if c not in exclude]
    for name, expr in (computed or {}).items():
        cols.append(expr.alias(name))
    return df.select(*cols)


def with_cast(df: DataFrame, expr: str, name: str) -> DataFrame:
    """``select *, <expr> as name`` (e.g. ``cast(tone as tinyint)``)."""
    return df.selectExpr("*", f"{expr} AS `{name}`")


def to_declared_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a declared schema, casting each field to its type."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


# ---------------------------------------------------------------- data-driven cuts

def with_quantile_cuts(df: DataFrame, col: str, probs: Sequence[float],
                       names: Sequence[str], accuracy: int | None = None,
                       exact: bool = True) -> DataFrame:
    """Attach quantiles of ``col`` as constant columns (two-pass, E15).

    ``exact=True``: interpolated exact quantiles found by sketch brackets
    (``operators.quantiles``); the few resulting numbers become literals.
    ``exact=False``: the GK sketch (``percentile_approx``) as a scalar
    subquery.  Neither gathers the column nor joins it with anything.
    """
    from evstat.operators.quantiles import exact_quantiles

    if exact:
        vals = exact_quantiles(df, col, probs)
        return df.withColumns({n: F.lit(v).cast("double") for n, v in zip(names, vals)})
    acc = accuracy or 10000
    qs = df.agg(F.percentile_approx(F.col(col), list(probs), acc)).scalar()  # one sketch pass
    return df.withColumns({n: qs[i] for i, n in enumerate(names)})


def with_mean_cut(df: DataFrame, col: str, name: str) -> DataFrame:
    """Attach ``avg(col)`` as a constant column via a scalar subquery."""
    return df.withColumn(name, df.agg(F.avg(F.col(col))).scalar())
