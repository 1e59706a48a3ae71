"""Operator 9: mixing sources to target weights.

Every row gets a hash-random key; rows are range-sorted by (source, key),
prefix sums of their sizes are built from per-range totals, and each source
is cut where its budget is reached.  Only ``(source, key, size)`` is ever
sorted: the result of the sort is one cut per source, which a small join
brings back to the rows, so texts are never shuffled.

DataFrame functions only.

Cases: a null text has size 0; a null source is a source of its own (last in
order); sources whose rows all have size 0 get target 0; repeated rows share
one key and share the words that a cut leaves them in equal parts (the rest of
the division is not taken); no rows give no rows; other columns pass through
``mix`` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evstat.llm.common import materialise, task_partitions

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)      # repeated over the sources in order
SHARE = 1.5              # the mix holds this share of all words
EPOCHS = 2               # no source is taken more often


def size_col(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def key_col(doc_id: str, text: str, seed: str = "mix") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"),
                          F.coalesce(F.col(text), F.lit(""))))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
            epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Sources in code point order, null last, weigh ``weights`` in turn.  A
    source stops at ``epochs`` times its size and what it cannot take is
    shared by weight among the others until none is above its stop.  The end
    state is one level: every source gets ``min(stop, level * weight)``;
    the level is read off the sources sorted by ``stop / weight``.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("w"),
                     (F.col("source_size") * float(epochs)).alias("stop"))
    s = s.withColumn("r", F.col("stop") / F.col("w"))
    up = Window.orderBy("r", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything) * float(share))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
                     / F.sum("w").over(rest))
    s = s.withColumn("level", F.first(F.when(F.col("level") <= F.col("r"), F.col("level")), ignorenulls=True)
                     .over(everything))
    return s.select("source", "source_size",
                    F.coalesce(F.least("stop", F.col("level") * F.col("w")), F.col("stop")).alias("target"))


def cuts(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """One row a source: how often it is taken whole (``full``), and for the rest the
    key at which it stops, with the words and rows under that key.

    rows: ``source, key, size``; goal: what ``targets`` returns."""
    spark = rows.sparkSession
    ranged = (rows.repartitionByRange(task_partitions(spark), "source", "key")
              .withColumn("part", F.spark_partition_id()))
    ranged = materialise(ranged, "mix-ranged")
    part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (ranged.groupBy("source", "part").agg(F.sum("size").alias("held"))
             .withColumn("before", F.coalesce(F.sum("held").over(part), F.lit(0))))
    goal = (goal.withColumn("full", F.when(F.col("source_size") > 0,
                                           F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
            .withColumn("rest", (F.floor("target") - F.col("full") * F.col("source_size")).cast("long"))
            .withColumn("rest", F.greatest(F.col("rest"), F.lit(0))))
    # only the one range of each source in which the rest is used up is looked into
    cut_part = (parts.join(goal.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")))
                .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("held")))
                .select(F.col("source").alias("s3"), F.col("part").alias("p3"), "before", "rest"))
    inside = (ranged.join(cut_part, F.col("source").eqNullSafe(F.col("s3")) & (F.col("part") == F.col("p3")))
              .groupBy("source", "part", "before", "rest", "key")
              .agg(F.sum("size").alias("words"), F.count("*").alias("copies")))
    run = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = (inside.withColumn("end", F.col("before") + F.sum("words").over(run))
          .where((F.col("end") > F.col("rest")) & (F.col("end") - F.col("words") <= F.col("rest")))
          .select(F.col("source").alias("s4"), F.col("key").alias("cut_key"),
                  F.floor((F.col("rest") - (F.col("end") - F.col("words"))) / F.col("copies")).alias("cut_words")))
    return (goal.join(at, F.col("source").eqNullSafe(F.col("s4")), "left")
            .select(F.col("source").alias("cut_source"), F.col("source_size"), "target",
                    F.col("full").cast("long").alias("full"), "cut_key", F.col("cut_words").cast("long").alias("cut_words")))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *,
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
        seed: str = "mix", prefix: str = "mix_") -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_taken``.

    ``taken`` counts words over all epochs: whole epochs first, then rows in
    key order until the source's budget is used up; the row at the cut gives
    the words that are left.
    """
    light = materialise(docs.select(F.col(source).alias("source"), key_col(doc_id, text, seed).alias("key"),
                                    size_col(text).alias("size")), "mix-sizes")
    goal = materialise(targets(light.groupBy("source").agg(F.sum("size").alias("source_size")),
                               weights, share, epochs), "mix-goal")
    cut = materialise(cuts(light, goal), "mix-cuts")
    cut = cut.select(*[F.col(c).alias(f"_{prefix}{c}") for c in cut.columns])
    q = lambda c: F.col(f"_{prefix}{c}")
    out = (docs.withColumn(f"_{prefix}key", key_col(doc_id, text, seed))
           .withColumn(f"{prefix}size", size_col(text))
           .join(cut, docs[source].eqNullSafe(q("cut_source")), "left"))
    size, key = F.col(f"{prefix}size"), q("key")
    part = (F.when(q("cut_key").isNull() | (key > q("cut_key")), F.lit(0))
            .when(key < q("cut_key"), size).otherwise(F.least(size, q("cut_words"))))
    return out.select(*[docs[c] for c in docs.columns], size, q("source_size").alias(f"{prefix}source_size"),
                      q("target").alias(f"{prefix}target"),
                      (q("full") * size + part).cast("long").alias(f"{prefix}taken"))


def repeat_rows(mixed: DataFrame, columns: Sequence[str], text: str = "text", n_chars: str | None = "n_chars",
                prefix: str = "mix_") -> DataFrame:
    """The mixed corpus as rows: a row for each time a document is taken, the one at
    a source's cut shortened to the words that its budget leaves."""
    size, taken = F.col(f"{prefix}size"), F.col(f"{prefix}taken")
    times = F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))
    rows = mixed.where(taken > 0).withColumn(f"_{prefix}epoch", F.explode(times))
    words = F.least(size, taken - (F.col(f"_{prefix}epoch") - 1) * size)
    # pieces end where a word ends, so the first n of them hold n words and what stands between
    pieces = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")
    rows = rows.withColumn(text, F.when(words < size, head).otherwise(F.col(text)))
    if n_chars in columns:
        rows = rows.withColumn(n_chars, F.when(words < size, F.length(text).cast("long")).otherwise(F.col(n_chars)))
    return rows.select(*columns)
