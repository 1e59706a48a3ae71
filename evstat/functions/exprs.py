"""Column expressions.

All helpers return ``pyspark.sql.Column`` built from built-in functions,
so they stay inside whole-stage codegen.  They are meant to be combined
in one ``withColumns`` call (see ``operators.prep.add_fields``) so that
every new field is computed from the *input* row.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

NULL_POLICIES = ("lowest", "default", "null")

_OPS = {
    "<": lambda x, c: x < c,
    "<=": lambda x, c: x <= c,
    ">": lambda x, c: x > c,
    ">=": lambda x, c: x >= c,
    "==": lambda x, c: x == c,
    "!=": lambda x, c: x != c,
}


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- fills

def fill_from(c: ColumnOrName, *fallbacks: ColumnOrName) -> Column:
    """First non-null of ``c`` and the fallback columns (E1, ``ifNull``)."""
    return F.coalesce(_col(c), *[_col(f) for f in fallbacks])


def fill_literal(c: ColumnOrName, value: Any = "") -> Column:
    """Replace null with a literal."""
    return F.coalesce(_col(c), F.lit(value))


# ---------------------------------------------------------------- binning

def _null_guard(x: Column, nulls: str) -> tuple[Column, Column | None]:
    """Return the value to compare and a null/NaN test (or None).

    ``lowest``: null and NaN compare below every number, as in the
    document store the reference reads from (trap T1/T2); realised by
    comparing ``-inf`` instead.
    """
    if nulls not in NULL_POLICIES:
        raise ValueError(f"nulls must be one of {NULL_POLICIES}, got {nulls!r}")
    x = x.cast("double")
    missing = x.isNull() | F.isnan(x)
    if nulls == "lowest":
        return F.when(missing, F.lit(float("-inf"))).otherwise(x), None
    return x, missing


def bin_by_rules(
    c: ColumnOrName,
    rules: Sequence[tuple[str, float | Column, Any]],
    default: Any,
    nulls: str = "lowest",
) -> Column:
    """First matching rule wins: ``rules = [(op, cut, label), ...]``.

    ``op`` is one of ``< <= > >= == !=``; a cut is a number or a column (a
    data-driven cut, E15).  Rows matching no rule get
    ``default``.  ``nulls`` decides where null / NaN go:
    ``lowest`` (below every cut), ``default`` or ``null``.
    """
    x, missing = _null_guard(_col(c), nulls)
    expr = None
    for op, cut, label in rules:
        cond = _OPS[op](x, cut if isinstance(cut, Column) else F.lit(float(cut)))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        expr = F.lit(default)
    else:
        expr = expr.otherwise(F.lit(default))
    if missing is not None:
        fill = F.lit(default) if nulls == "default" else F.lit(None).cast(expr_type(default))
        expr = F.when(missing, fill).otherwise(expr)
    return expr


def expr_type(v: Any) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "double"
    return "string"


def bin_ordinal(
    c: ColumnOrName,
    cuts: Sequence[float],
    labels: Sequence[Any] | None = None,
    default: Any = -1,
    nulls: str = "lowest",
) -> Column:
    """Ordinal bin by ascending ``<`` cuts (E5): ``x < cuts[i]`` gives ``labels[i]``.

    ``labels`` defaults to 1..len(cuts); values not below the last cut get
    ``default``.
    """
    cuts = list(cuts)
    if any(b <= a for a, b in zip(cuts, cuts[1:])):
        raise ValueError("cuts must be strictly ascending")
    labels = list(labels) if labels is not None else list(range(1, len(cuts) + 1))
    if len(labels) != len(cuts):
        raise ValueError("need one label per cut")
    return bin_by_rules(c, [("<", cut, lab) for cut, lab in zip(cuts, labels)], default, nulls)


def bin_three_way(
    c: ColumnOrName,
    upper: float,
    lower: float,
    labels: tuple[str, str, str] = ("positive", "negative", "neutral"),
    nulls: str = "lowest",
) -> Column:
    """``x >= upper`` -> labels[0]; ``x <= lower`` -> labels[1]; else labels[2]."""
    return bin_by_rules(c, [(">=", upper, labels[0]), ("<=", lower, labels[1])], labels[2], nulls)


def bin_two_way(
    c: ColumnOrName,
    cut: float,
    labels: tuple[str, str, str] = ("positive", "negative", "invalid"),
    nulls: str = "lowest",
) -> Column:
    """``x >= cut`` -> labels[0]; ``x < cut`` -> labels[1]; else labels[2]."""
    return bin_by_rules(c, [(">=", cut, labels[0]), ("<", cut, labels[1])], labels[2], nulls)


def label_binary(c: ColumnOrName, cut: float, nulls: str = "lowest") -> Column:
    """``x <= cut`` -> 0 else 1."""
    return bin_by_rules(c, [("<=", cut, 0)], 1, nulls)


# ---------------------------------------------------------------- flags, arithmetic

def same_flag(a: ColumnOrName, b: ColumnOrName) -> Column:
    """``a == b``; a null on either side gives false."""
    return F.coalesce(_col(a) == _col(b), F.lit(False))


def rescale(c: ColumnOrName, offset: float, span: float) -> Column:
    """Linear rescale ``(x + offset) / span`` on doubles."""
    return (_col(c).cast("double") + F.lit(float(offset))) / F.lit(float(span))


def round_half_even(c: ColumnOrName, scale: int = 0) -> Column:
    """Banker's rounding, as the document store rounds (E9, trap T5)."""
    return F.bround(_col(c), scale)


# ---------------------------------------------------------------- casts

def number_to_text(c: ColumnOrName) -> Column:
    """Number to string; whole doubles print without ``.0`` (E10, trap T6)."""
    x = _col(c)
    d = x.cast("double")
    whole = (d == F.floor(d)) & ~F.isnan(d) & (F.abs(d) < F.lit(9.0e18))
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def to_text(c: ColumnOrName) -> Column:
    """Plain cast to string."""
    return _col(c).cast("string")


def to_tinyint(c: ColumnOrName) -> Column:
    """Cast to TINYINT; under ANSI mode an overflow raises."""
    return _col(c).cast("tinyint")


def numeric_reading(c: ColumnOrName) -> Column:
    """Double reading of a column; text that is not a number gives null (trap T16)."""
    return F.expr(f"try_cast({_name(c)} as double)") if isinstance(c, str) else c.try_cast("double")


def _name(c: ColumnOrName) -> str:
    return f"`{c}`" if isinstance(c, str) else str(c)
