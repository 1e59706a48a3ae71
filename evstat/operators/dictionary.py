"""String index of several columns as one distributed dictionary (M1, M2).

MLlib's indexer brings every label of every column to the driver.  Here the labels of all
columns are counted in one aggregate (partial counts first, so a hot label is a row a
task), ranked in one range sort by column, count and value, and joined back.

A label that holds at least ``1 / HOT_SHARE`` of the rows would send them all to one task of
that join.  There are at most ``HOT_SHARE`` such labels a column, so they are broadcast; the
other rows meet the dictionary in a shuffle in which no label has more than that share.
Rows that the broadcast settled are spread by their own hash there.

Cases: a null is no label; with ``skip`` rows with a null or unknown label in any column go,
with ``keep`` they get the number of the column's labels, with ``error`` reading them raises;
labels are compared as text; ties in count go to the smaller text; an empty table has an
empty dictionary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evstat.operators.features import ranked
from evstat.session import reliable_checkpoint

HOT_SHARE = 1000


def label_dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, value, n, idx``: labels of every column, the most frequent first (idx from 0 in each)."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)])
    counts = reliable_checkpoint(df.select(F.inline(cells)).where(F.col("value").isNotNull())
                                 .groupBy("c", "value").agg(F.count("*").alias("n")))
    sizes = {r["c"]: r["n"] for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()}     # a row a column
    first, names = F.lit(0), F.lit(None).cast("string")
    for i, c in enumerate(cols):
        first = F.when(F.col("c") == i, F.lit(sum(sizes.get(k, 0) for k in range(i)))).otherwise(first)
        names = F.when(F.col("c") == i, F.lit(c)).otherwise(names)
    out = ranked(counts, [F.col("c"), F.col("n").desc(), F.col("value")], "place")
    return out.select(names.alias("column"), "value", "n", (F.col("place") - first).cast("double").alias("idx"))


def with_indices(df: DataFrame, dictionary: DataFrame, cols: Sequence[str], outs: Sequence[str], invalid: str = "error") -> DataFrame:
    """``df`` with the index of each of ``cols`` under ``outs``.  ``dictionary`` should be a written table: it is read
    for each column.  The rows' other columns pass through; names in ``outs`` are replaced."""
    if invalid not in ("error", "skip", "keep"):
        raise ValueError(f"invalid={invalid!r}")
    names = list(dict.fromkeys([*[c for c in df.columns if c not in outs], *outs]))
    out = df.drop(*[c for c in outs if c not in cols])
    for at, (c, name) in enumerate(zip(cols, outs, strict=True)):
        own = dictionary.where(F.col("column") == c)
        total, labels = own.agg(F.sum("n"), F.count("*")).first()
        hot = (F.col("n") * HOT_SHARE >= F.lit(total or 1))
        value, left, right, key, open_ = (f"_dict{at}_{x}" for x in ("value", "hot", "cold", "key", "open"))
        some = F.broadcast(own.where(hot).select(F.col("value").alias(value), F.col("idx").alias(left)))
        rest = own.where(~hot).select(F.col("value").alias(key), F.col("idx").alias(right), F.lit(True).alias(open_))
        text = F.col(c).cast("string")
        out = out.join(some, text == F.col(value), "left")
        settled = F.col(left).isNotNull() | F.col(c).isNull()
        spread = F.xxhash64(*[F.col(f"`{x}`") for x in df.columns if x in out.columns and df.schema[x].dataType.typeName() != "map"])
        out = out.withColumns({f"{key}2": F.when(settled, spread.cast("string")).otherwise(text), f"{open_}2": ~settled})
        out = out.join(rest, (F.col(f"{key}2") == F.col(key)) & (F.col(f"{open_}2") == F.col(open_)), "left")
        idx = F.coalesce(left, right)
        if invalid == "keep":
            idx = F.coalesce(idx, F.lit(float(labels)))
        elif invalid == "error":
            said = F.concat(F.lit(f"label of {c} not in the dictionary: "), F.coalesce(text, F.lit("null")))
            idx = F.coalesce(idx, F.raise_error(said).cast("double"))
        else:
            out = out.where(idx.isNotNull())
        out = out.withColumn(f"_dict{at}", idx).drop(value, left, right, key, open_, f"{key}2", f"{open_}2")
    found = {name: F.col(f"_dict{at}") for at, name in enumerate(outs)}
    return out.select(*[found[n].alias(n) if n in found else F.col(f"`{n}`") for n in names])
