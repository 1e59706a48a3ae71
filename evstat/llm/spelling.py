"""Operator 12: spelling variants by blocked Gram matrices of letter counts.

Words are runs of Latin letters with only A-Z lowered; one occurrence in
``NOISE`` by hash loses a letter (the fixed noise rule below).  Words of at least
``min_length`` letters and ``min_count`` occurrences form blocks of equal length and
equal numbers of letters of each of a few letter sets.  One edit changes a letter
count by one (insert, delete: the next length) or moves one between two letters
(replace: the same length), so near words lie in the same block or one of few
neighbours, whose keys differ from the block's by fixed amounts: each block visits
only those.  Where two blocks meet, one NumPy product of their letter-count
matrices gives all squared distances; pairs at most 2 apart are then compared letter
by letter.

The number of letter sets follows the number of words, so a block keeps about
``BLOCK_WORDS`` words on average; a block with more letters than ``BLOCK_LETTERS`` is
dealt into chunks by hash, and each chunk meets each chunk of the neighbours.

Then each word takes as form its near word of most occurrences (ties: first in
code-point order) if it has at least twice its own; counts at least double along
forms, so there are no cycles, and roots are found by doubling jumps.

Cases: a null text has no words, a null id counts as the empty string in the hash;
repeated rows count as often as they stand; empty tables give no rows; very long texts
are read whole, a very long word is a chunk alone; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evstat.llm.common import materialise, rows_per_batch

RUN = "[A-Za-zÀ-ÿ]+"
NOISE = 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
BLOCK_WORDS = 400
BLOCK_LETTERS = 4096
COLUMNS = 32            # 26 letters, and 6 shared by the accented ones
CELLS = 1 << 22         # entries of a distance matrix or letters of pairs handled at once


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """``word, n``: the words after the noise rule, with their occurrences in all texts."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    cut = (h % F.length("run")).cast("int")
    word = F.when(h % NOISE == 0, F.concat(F.substring(F.col("run"), F.lit(1), cut), F.substring(F.col("run"), cut + 2, F.length("run"))))
    words = runs.select(word.otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- blocks

def letter_sets(words: int) -> list[str]:
    """Letters dealt to as few sets as keep blocks near BLOCK_WORDS words on average.

    Counts of ``g`` even sets in a word of about 10 letters fall on about
    ``(4 pi 10) ** ((g - 1) / 2) / g ** (g / 2)`` values (the multinomial's collision
    probability), in each of about 10 common lengths.
    """
    g = 1
    while g < 12 and words / 10 / ((40 * math.pi) ** ((g - 1) / 2) / g ** (g / 2)) > BLOCK_WORDS:
        g += 1
    common = "eainrtoslucdmhgpbvfyzkwjxq" + ACCENTED      # roughly by frequency, so sets are even
    return ["".join(c for i, c in enumerate(common) if (i if (i // g) % 2 == 0 else g - 1 - i) % g == j) for j in range(g)]


def _weights(n: int) -> list[int]:
    """A fixed 62-bit number for each letter set; a block's key is the sum over its letters, modulo 2 ** 62."""
    rng = np.random.default_rng(12)
    return [int(x) | 1 for x in rng.integers(1 << 60, 1 << 61, n)]


_MOD = 1 << 62


def block_key(word: Column, sets: list[str]) -> Column:
    """Every letter belongs to a set, so the key names the length as well."""
    key = F.lit(0).cast("long")
    for letters, w in zip(sets, _weights(len(sets)), strict=True):
        count = (F.length(word) - F.length(F.translate(word, letters, ""))).cast("decimal(38,0)")
        key = F.pmod(key + F.pmod(count * F.lit(w).cast("decimal(38,0)"), F.lit(_MOD).cast("decimal(38,0)")).cast("long"), F.lit(_MOD))
    return key


def _deltas(n: int) -> list[int]:
    """Key differences to the blocks that a block visits: itself, one letter more, one letter moved.
    Of a move and its reverse only one is listed, so a pair of blocks meets once."""
    w = _weights(n)
    return [0, *w, *[(a - b) % _MOD for a, b in combinations(w, 2)]]


def chunks(counts: DataFrame, sets: list[str]) -> DataFrame:
    """``key, chunk, length, letters, counts``: blocks, those of many letters dealt into several chunks.
    The words of a chunk have one length; ``letters`` holds them end to end."""
    keyed = materialise(counts.withColumn("key", block_key(F.col("word"), sets)), "spell-keyed")
    size = keyed.groupBy("key").agg(F.ceil(F.sum(F.length("word")) / BLOCK_LETTERS).cast("long").alias("parts"))
    dealt = keyed.join(size, "key").withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("parts")))
    whole = dealt.groupBy("key", "chunk").agg(F.first(F.length("word")).alias("length"), F.collect_list(F.struct("word", "n")).alias("w"))
    return materialise(whole.select("key", "chunk", "length", F.array_join("w.word", "").alias("letters"), F.col("w.n").alias("counts")),
                       "spell-chunks")


# ---------------------------------------------------------------- pairs

def points(letters: str, length: int) -> np.ndarray:
    """Code points of words of one length that stand end to end, a row for each word."""
    return np.frombuffer(letters.encode("utf-32-le"), np.uint32).reshape(-1, length)


def _column_of() -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[97:123] = np.arange(26)
    table[0xC0:] = 26 + np.arange(64) % 6
    return table


_COLUMN = _column_of()


def letter_counts(words: np.ndarray) -> np.ndarray:
    """A row of COLUMNS letter counts for each row of code points."""
    n, length = words.shape
    at = _COLUMN[words & 0xFF] + (np.arange(n) * COLUMNS)[:, None]
    kind = np.float32 if length < 1000 else np.float64                   # sums of squares stay exact
    return np.bincount(at.ravel(), minlength=n * COLUMNS).reshape(n, COLUMNS).astype(kind)


def close_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose letter counts have a squared distance of at most 2, from one product."""
    one = np.ones((len(a), 1), a.dtype)
    left = np.hstack([a, (a * a).sum(1, keepdims=True), one])
    right = np.hstack([-2 * b, np.ones((len(b), 1), b.dtype), (b * b).sum(1, keepdims=True)])
    found = []
    step = max(1, CELLS // max(1, len(b)))
    for lo in range(0, len(a), step):
        i, j = np.nonzero(left[lo:lo + step] @ right.T <= 2)
        found.append((i + lo, j))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return i, j


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of code points of one length, or ``b`` one longer: whether exactly one edit leads from one to the other."""
    m, n = a.shape[1], b.shape[1]
    if m == n:
        return (a != b).sum(1) == 1
    same, shifted = a == b[:, :m], a == b[:, 1:]
    head = np.where(same.all(1), m, np.argmin(same, axis=1))                     # letters equal from the left
    tail = np.where(shifted.all(1), m, np.argmin(shifted[:, ::-1], axis=1))      # and from the right
    return head + tail >= m


def near_words(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of near words in two chunks of code points (``b`` None: within the chunk, each pair once);
    ``b``'s words are of the same length or one longer."""
    own, b = b is None, a if b is None else b
    i, j = close_pairs(letter_counts(a), letter_counts(b))
    if own:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return i, j
    step = max(1, CELLS // b.shape[1])
    ok = np.concatenate([one_edit(a[i[lo:lo + step]], b[j[lo:lo + step]]) for lo in range(0, len(i), step)])
    return i[ok], j[ok]


_PAIRS = "a string, na long, b string, nb long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = {c: batch.column(c) for c in batch.schema.names}
        for r in range(batch.num_rows):
            size, size2, own = (get[c][r].as_py() for c in ("length", "length2", "own"))
            letters, letters2 = get["letters"][r].as_py(), get["letters2"][r].as_py()
            i, j = near_words(points(letters, size), None if own else points(letters2, size2))
            if len(i):
                n, n2 = (get[c][r].values.to_numpy() for c in ("counts", "counts2"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([letters[x:x + size] for x in (i * size).tolist()]), pa.array(n[i]),
                     pa.array([letters2[x:x + size2] for x in (j * size2).tolist()]), pa.array(n2[j])], names=["a", "na", "b", "nb"])


def near_pairs(blocks: DataFrame, sets: list[str]) -> DataFrame:
    """``a, na, b, nb``: each pair of near words once."""
    deltas = F.array(*[F.lit(d).cast("long") for d in _deltas(len(sets))])
    kept = ["length", "letters", "counts"]
    home = blocks.select("chunk", *kept, F.posexplode(deltas).alias("move", "delta"), "key")
    home = home.withColumn("key", F.pmod(F.col("key") + F.col("delta"), F.lit(_MOD)))
    other = blocks.select("key", F.col("chunk").alias("chunk2"), *[F.col(c).alias(f"{c}2") for c in kept])
    met = home.join(other, "key").where((F.col("move") > 0) | (F.col("chunk") <= F.col("chunk2")))
    met = met.select(*kept, *[f"{c}2" for c in kept], ((F.col("move") == 0) & (F.col("chunk") == F.col("chunk2"))).alias("own"))
    with rows_per_batch(blocks.sparkSession, 64):
        return materialise(met.mapInArrow(_compare, _PAIRS), "spell-pairs")


# ---------------------------------------------------------------- forms and roots

def roots(links: DataFrame) -> DataFrame:
    """``word, form`` without cycles to ``word, root``: jumps double until every word points at a last one."""
    at = links.select("word", F.col("form").alias("root"))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = materialise(at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                              F.col("further").isNotNull().alias("moved")), "spell-roots")
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word."""
    counts = materialise(word_counts(docs, doc_id, text, min_length=min_length, min_count=min_count), "spell-words")
    sets = letter_sets(counts.count())
    pairs = near_pairs(chunks(counts, sets), sets)
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("own"), F.col("b").alias("near"), F.col("nb").alias("near_n"))
    both = both.union(pairs.select(F.col("b"), F.col("nb"), F.col("a"), F.col("na")))
    best = F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near")))       # most occurrences, then code-point order
    seen = both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("own").alias("own"), best.alias("best"))
    strong = -F.col("best.neg") >= 2 * F.col("own")
    seen = materialise(seen.select("word", "n_near", F.when(strong, F.col("best.near")).alias("form"),
                                   F.when(strong, -F.col("best.neg")).alias("form_n")), "spell-forms")
    last = roots(seen.where(F.col("form").isNotNull()))
    out = counts.join(seen, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
