"""Random split of exact proportions that no partitioning, order or retry changes.

``randomSplit`` draws a number a row inside each partition: sizes only come near the weights, and
another layout of the same rows gives another split.  Here a row's place is that of the md5 digest
of its id, and part ``i`` ends at place ``floor(N * (w_0 + .. + w_i) / sum(w) + 1/2)``.

No row is sorted or shuffled for it.  One aggregate counts the digests by their first four hex
digits (65,536 counts at most, whatever the data); they name the few prefixes in which a part ends.
A second read counts the digests under those prefixes, 1 / 65,536 of the rows each, into a written
table, which the same step then narrows by four more digits at a time until a prefix holds one digest.  The
split itself compares each row's digest with one literal a cut, in the scan that uses it.

Cases: rows of equal ids have one digest and stay together, so a group larger than one is given to
the part that its larger half falls in (half each: the earlier one) and sizes then differ by less than
the group; unique ids give exact sizes.  A null id is an id of its own, and not the empty text.
A weight of 0 gives an empty part; an empty table gives empty parts.  Weights count as the decimals that
they print as.  Other columns pass through; a column of the label's name is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evstat.session import reliable_checkpoint

STEP = 4        # hex digits a narrowing step: at most 16 ** 4 counts a prefix reach the driver


def split_digest(ids: Sequence[str], seed: int) -> Column:
    """Hex digest of the seed and the id columns; ``~`` stands for a null, and ``:`` leads each other value."""
    text = [F.coalesce(F.concat(F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("~")) for c in ids]
    return F.md5(F.concat(F.lit(str(int(seed))), *text))


def cut_places(weights: Sequence[float], total: int) -> list[int]:
    """Place (from 0) at which each part but the first begins."""
    shares = [Fraction(str(w)) for w in weights]
    if not shares or min(shares) < 0 or not sum(shares):
        raise ValueError("weights must be at least 0 and not all 0")
    places, run = [], Fraction(0)
    for w in shares[:-1]:
        run += w
        places.append(int(total * run / sum(shares) + Fraction(1, 2)))
    return places


def _counts(digests: DataFrame, width: int, under: Sequence[str]) -> dict[str, tuple[int, str, str]]:
    """Rows, least and greatest digest of each prefix of ``width`` digits that extends one of ``under``.  Where
    ``under`` is empty the prefixes of all rows are counted, by hash: ends of texts would need the rows sorted."""
    ends = [F.min("d").alias("low"), F.max("d").alias("high")] if under else [F.lit("").alias("low"), F.lit("~").alias("high")]
    rows = digests.groupBy(F.substring("d", 1, width).alias("p")).agg(F.sum("n").alias("n"), *ends)
    if under:
        rows = rows.where(F.substring("p", 1, width - STEP).isin(list(under)))
    return {r["p"]: (r["n"], r["low"], r["high"]) for r in rows.collect()}     # 16 ** STEP a prefix in ``under``


def cut_digests(df: DataFrame, ids: Sequence[str], weights: Sequence[float], seed: int = 42) -> list[tuple[str, bool] | None]:
    """For each part but the first, the digest at which it begins and whether that digest is in it;
    None where it begins after all rows."""
    digests = df.select(split_digest(ids, seed).alias("d"), F.lit(1).alias("n"))
    counts = _counts(digests, STEP, ())
    total = sum(n for n, _, _ in counts.values())
    places = cut_places(weights, total)
    inside = {p: ("", p) for p in places if p < total}      # place -> prefix, place in that prefix
    width, small = STEP, digests
    while inside:
        ordered = sorted(counts)
        for p, (prefix, left) in inside.items():
            for name in ordered:
                if name.startswith(prefix):
                    if left < counts[name][0]:
                        inside[p] = name, left
                        break
                    left -= counts[name][0]
        named = sorted({prefix for prefix, _ in inside.values()})
        if all(counts[x][1] == counts[x][2] for x in named):
            break       # each prefix holds one digest, at the latest at its full width
        if small is digests:
            small = reliable_checkpoint(digests.where(F.substring("d", 1, STEP).isin(named))
                                        .groupBy("d").agg(F.count("*").alias("n")))
        width += STEP
        counts = _counts(small, width, named)
    found = {p: (counts[x][1], 2 * left < counts[x][0]) for p, (x, left) in inside.items()}
    return [found.get(p) for p in places]


def exact_split(df: DataFrame, ids: Sequence[str], weights: Sequence[float], names: Sequence[str] | None = None,
                seed: int = 42, label: str = "part") -> DataFrame:
    """``df`` with the part of each row under ``label``: its number, or its name if ``names`` are given."""
    if names is not None and len(names) != len(weights):
        raise ValueError("one name a weight")
    part = F.lit(0)
    for cut in cut_digests(df, ids, weights, seed):
        if cut is not None:
            d = split_digest(ids, seed)
            part = part + ((d >= cut[0]) if cut[1] else (d > cut[0])).cast("int")
    if names is not None:
        part = F.element_at(F.array(*[F.lit(n) for n in names]), part + 1)
    return df.withColumn(label, part)
