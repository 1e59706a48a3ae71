"""Operator 11: hard negatives by angular triangle filtering.

A vector's components become whole numbers, ``floor(scale * x)``, and a score is
the integer inner product with an anchor.  Each row stores its angles to a few
reference directions.  For two vectors the triangle inequality on the sphere puts
their angle between the largest difference and the smallest sum of stored angles;
cosines of these ends times both norms, widened for rounding, bound the score
from both sides.  A row is scored for an anchor only if its bounds reach the
anchor's present k-th positive, or overlap one of the anchor's windows above
the present k-th negative there.

Rows travel in blocks.  A task holds one group of anchors (``GROUP`` about) and
streams the row blocks of one part past it, so it holds one row block and the best
few of each anchor whatever the table's size.  Every anchor meets every part once;
the parts' best are merged by anchor.

References are chosen farthest-first from the ``SAMPLE`` rows of smallest id hash;
a length of vector absent from the sample takes seeded random directions.  They
decide only how many pairs are scored, never the result.

Cases: rows with a null id, label or vector, an empty vector, or any null or
non-finite component take no part; rows of one id count once (the smallest label,
then vector); vectors of different lengths never meet; ties go to the smaller id; a
negative positive score opens no window; an anchor without positives or
a window without rows gives no row; scores beyond a long saturate in the output;
no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evstat.llm.common import materialise, rows_per_batch, task_partitions

REFERENCES = 12
SAMPLE = 64          # rows from which references are chosen
BLOCK = 512          # rows of a block
GROUP = 1024         # anchors of a group, about
PART = 4096          # rows of a part, about
MAX_PARTS = 256      # parts grow beyond PART rows from here on
SLACK = 4e-6         # radians; stored angles are single precision
EXACT = 2.0 ** 53    # below, sums of doubles are exact whole numbers
LONG = 2 ** 63 - 1

_BLOCK = "dim int, kind string, ids binary, labels binary, vectors binary, angles binary, positives binary"


# ---------------------------------------------------------------- angles and bounds

def reference_directions(sample: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """Unit vectors, farthest-first from the sample of this length (random ones where there is none)."""
    pool = sample.get(dim)
    if pool is None or not len(pool):
        pool = np.random.default_rng(dim).standard_normal((REFERENCES, dim))
    pool = pool / np.sqrt((pool * pool).sum(1, keepdims=True))
    chosen, near = [0], pool @ pool[0]
    while len(chosen) < min(REFERENCES, len(pool)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, pool @ pool[chosen[-1]])
    return pool[chosen]


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(1))


def angles(v: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angle of each row to each reference; a zero vector's angles are never decisive (its norm is 0)."""
    n = norms(v)
    return np.arccos(np.clip(v @ refs.T / np.where(n > 0, n, 1)[:, None], -1, 1)).astype(np.float32)


def score_bounds(a: np.ndarray, na: np.ndarray, x: np.ndarray, nx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible score of every anchor (angles ``a``) with every row (angles ``x``)."""
    least = np.zeros((len(a), len(x)), np.float32)
    most = np.full((len(a), len(x)), np.pi, np.float32)
    for r in range(a.shape[1]):
        p, q = a[:, r, None], x[None, :, r]
        np.maximum(least, np.abs(p - q), out=least)
        total = p + q
        np.minimum(most, np.minimum(total, np.float32(2 * np.pi) - total), out=most)
    size = na[:, None] * nx[None, :]
    pad = 1 + 1e-9 * size
    upper = size * np.cos(np.maximum(least - SLACK, 0).astype(np.float64)) + pad
    lower = size * np.cos(np.minimum(most + SLACK, np.pi).astype(np.float64)) - pad
    return lower, upper


def integer_scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows; Python integers where doubles are not exact."""
    if not len(a) or not len(x) or norms(a).max() * norms(x).max() < EXACT:
        return (a @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(x).T, -LONG, LONG).astype(np.int64)


# ---------------------------------------------------------------- blocks

def _record(dim: int, v: np.ndarray, ids: np.ndarray, labels: np.ndarray, refs: np.ndarray, positives: np.ndarray | None) -> tuple:
    kind = "<i4" if np.abs(v).max() < 2 ** 31 else "<f8"
    return (dim, kind, ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), v.astype(kind).tobytes(),
            angles(v, refs).astype("<f4").tobytes(), b"" if positives is None else positives.astype("<i8").tobytes())


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.string(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                      names=[c.split()[0] for c in _BLOCK.split(", ")])


def _blocks(sample: dict[int, np.ndarray], scale: float, block: int):
    """Rows ``id, label, v[, positives]`` to blocks of at most ``block`` rows of one length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs: dict[int, np.ndarray] = {}
        held: dict[int, list[tuple]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            part = [np.concatenate(c) if c[0] is not None else None for c in zip(*held.pop(dim), strict=True)]
            return _to_batch([_record(dim, part[2], part[0], part[1], refs[dim], part[3])])

        for batch in batches:
            ids, labels, col = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            flat = col.flatten().to_numpy().astype(np.float64)
            length = pa.compute.list_value_length(col).to_numpy()
            start = np.cumsum(length) - length
            more = batch.column(3).flatten().to_numpy().reshape(len(ids), -1) if batch.num_columns > 3 else None
            for dim in np.unique(length).tolist():
                if dim not in refs:
                    refs[dim] = reference_directions(sample, dim)
                rows = np.flatnonzero(length == dim)
                for lo in range(0, len(rows), block):
                    r = rows[lo:lo + block]
                    v = np.floor(scale * flat[start[r][:, None] + np.arange(dim)])
                    held.setdefault(dim, []).append((ids[r], labels[r], v, None if more is None else more[r]))
                    if sum(len(x[0]) for x in held[dim]) >= block:
                        yield flush(dim)
        for dim in list(held):
            yield flush(dim)
    return run


class Block:
    """The numpy form of one row or anchor block."""

    def __init__(self, row: dict):
        self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        self.v = np.frombuffer(row["vectors"], row["kind"]).reshape(len(self.ids), -1).astype(np.float64)
        self.angles = np.frombuffer(row["angles"], "<f4").reshape(len(self.ids), -1)
        self.positives = np.frombuffer(row["positives"], "<i8").reshape(len(self.ids), -1)
        self.norms = norms(self.v)

    @staticmethod
    def joined(blocks: list[Block]) -> Block:
        out = object.__new__(Block)
        out.__dict__ = {k: np.concatenate([getattr(b, k) for b in blocks]) for k in vars(blocks[0])}
        return out


class Best:
    """The first ``k`` ids of each of ``n`` lists: highest score first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [np.zeros((0, 3), np.int64)]
        self.last = np.full(n, -np.inf)            # score of the k-th, once there are k

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(of):
            rows = np.concatenate([*self.rows, np.stack([of, score, ids], axis=1)])
            rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
            new = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            rank = np.arange(len(rows)) - np.repeat(new, np.diff(np.append(new, len(rows))))
            full = rows[rank == self.k - 1]
            self.last[full[:, 0]] = full[:, 1]
            self.rows = [rows[rank < self.k]]


# ---------------------------------------------------------------- tasks

def _scored(a: Block, x: Block, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer scores of the kept pairs only: ``(anchor, row, score)``."""
    i, j = np.flatnonzero(keep.any(1)), np.flatnonzero(keep.any(0))
    if not len(i):
        return i, i, i
    s = integer_scores(a.v[i], x.v[j])
    p, q = np.nonzero(keep[np.ix_(i, j)])
    return i[p], j[q], s[p, q]


_FOUND = "anchor_id long, slot int, score long, id long"


class Positives:
    """The best rows of the anchor's own label."""

    def __init__(self, anchors: Block, k: int):
        self.a, self.best = anchors, Best(len(anchors.ids), k)

    def see(self, x: Block) -> int:
        keep = self.a.labels[:, None] == x.labels[None, :]
        keep &= self.a.ids[:, None] != x.ids[None, :]
        i, j = np.flatnonzero(keep.any(1)), np.flatnonzero(keep.any(0))
        if not len(i):
            return 0
        _, upper = score_bounds(self.a.angles[i], self.a.norms[i], x.angles[j], x.norms[j])
        keep[np.ix_(i, j)] &= upper >= self.best.last[i][:, None]
        p, q, s = _scored(self.a, x, keep)
        self.best.add(p, s, x.ids[q])
        return len(p)

    def result(self) -> list[np.ndarray]:
        rows = self.best.rows[0]
        return [self.a.ids[rows[:, 0]], np.zeros(len(rows), np.int32), rows[:, 1], rows[:, 2]]


class Negatives:
    """The best rows of other labels inside each window of the anchor."""

    def __init__(self, anchors: Block, k: int, low: int, high: int):
        p = anchors.positives
        self.a, self.slots = anchors, p.shape[1]
        # whole-number ends of low * p <= 100 * n <= high * p, without products that leave a long
        self.low = np.where(p < 0, 1, p // 100 * low + (p % 100 * low + 99) // 100)
        self.high = np.where(p < 0, 0, p // 100 * high + p % 100 * high // 100)
        self.best = Best(len(anchors.ids) * self.slots, k)

    def see(self, x: Block) -> int:
        a = self.a
        lower, upper = score_bounds(a.angles, a.norms, x.angles, x.norms)
        # a window from the present k-th score on; an empty one (low > high) overlaps nothing
        low, high = np.maximum(self.low, self.best.last.reshape(-1, self.slots)), self.high
        keep = np.zeros(lower.shape, bool)
        for w in range(self.slots):
            keep |= (upper >= low[:, w, None]) & (lower <= high[:, w, None]) & (low[:, w] <= high[:, w])[:, None]
        keep &= a.labels[:, None] != x.labels[None, :]
        p, q, s = _scored(a, x, keep)
        found = []
        for w in range(self.slots):
            at = np.flatnonzero((s >= low[p, w]) & (s <= high[p, w]))
            found.append((p[at] * self.slots + w, s[at], x.ids[q[at]]))
        self.best.add(*[np.concatenate(c) for c in zip(*found, strict=True)])
        return len(p)

    def result(self) -> list[np.ndarray]:
        rows = self.best.rows[0]
        return [self.a.ids[rows[:, 0] // self.slots], (rows[:, 0] % self.slots).astype(np.int32), rows[:, 1], rows[:, 2]]


def _stream(search: Callable, k: int):
    """Rows sorted by (grp, part, dim, role): the anchors of a group, then the row blocks of a part."""
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchors, task = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (key := (row["grp"], row["part"], row["dim"])) != at:
                    if task is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in task.result()], names=names)
                    at, anchors, task = key, [], None
                if row["role"] == 0:
                    anchors.append(Block(row))
                elif anchors:
                    task = task or search(Block.joined(anchors), k)
                    task.see(Block(row))
        if task is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in task.result()], names=names)
    return run


def _meet(anchors: DataFrame, rows: DataFrame, groups: int, parts: int, search: Callable, k: int) -> DataFrame:
    """Every anchor block against every row block: a group of anchors with a part of the rows in a task."""
    deal = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumn("grp", deal(groups)).select(F.lit(0).alias("role"), "*", every(parts).alias("part"))
    x = rows.withColumn("part", deal(parts)).select(F.lit(1).alias("role"), "*", every(groups).alias("grp"))
    # beyond as many tasks, one takes several (group, part) in turn
    tasks = min(groups * parts, max(task_partitions(rows.sparkSession), 4096))
    dealt = (a.unionByName(x).repartitionById(tasks, F.pmod(F.col("grp") * F.lit(parts) + F.col("part"), F.lit(tasks)).cast("int"))
             .sortWithinPartitions("grp", "part", "dim", "role"))
    with rows_per_batch(rows.sparkSession, 16):
        return materialise(dealt.mapInArrow(_stream(search, k), _FOUND), "hn-found")


def _first(k: int) -> Column:
    """The first ``k`` of the parts' best, at most ``k`` rows a part."""
    pairs = F.collect_list(F.struct((-F.col("score")).alias("neg"), F.col("id")))
    return F.slice(F.array_sort(pairs), 1, k)


def hard_negatives(rows: DataFrame, is_anchor: Callable[[Column], Column], vec_id: str = "vec_id", label: str = "label",
                   vector: str = "embedding", *, scale: float = 256.0, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` takes the id column.  For each anchor and each of its first ``positives`` rows of the same
    label: the first ``negatives`` rows of other labels with ``low * p <= 100 * n <= high * p`` for
    positive score ``p`` and negative score ``n``.  ``label`` is a whole number, ``0 <= low <= high``.
    """
    v = F.col(vector)
    usable = (F.col(vec_id).isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0)
              & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    picked = rows.where(F.coalesce(usable, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), F.struct(F.col(label).cast("long").alias("label"), v.cast("array<double>").alias("v")).alias("r"))
    clean = materialise(picked.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.v"), "hn-rows")
    chosen = is_anchor(F.col("id"))
    n, q = clean.agg(F.count("*"), F.count_if(chosen)).first()
    sample: dict[int, list] = {}
    for r in clean.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():
        if any(r.v):
            sample.setdefault(len(r.v), []).append(r.v)
    pools = {d: np.array(x) for d, x in sample.items()}
    groups, parts = max(1, -(-q // GROUP)), min(max(1, -(-n // PART)), MAX_PARTS)

    blocks = materialise(clean.mapInArrow(_blocks(pools, scale, BLOCK), _BLOCK), "hn-blocks")
    anchors = clean.where(chosen)
    found = _meet(anchors.mapInArrow(_blocks(pools, scale, BLOCK), _BLOCK), blocks, groups, parts,
                  Positives, positives)
    best = materialise(found.groupBy("anchor_id").agg(_first(positives).alias("best")), "hn-positives")
    # scores in order; -1 where there is no further positive, or a negative score: no window
    none = F.array_repeat(F.lit(-1).cast("long"), positives)
    scores = F.slice(F.concat(F.transform("best", lambda b: F.greatest(-b["neg"], F.lit(-1))), none), 1, positives)
    asked = anchors.join(best.withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "v", scores.alias("positives"))
    found = _meet(asked.mapInArrow(_blocks(pools, scale, BLOCK), _BLOCK), blocks, groups, parts,
                  partial(Negatives, low=low, high=high), negatives)
    top = found.groupBy("anchor_id", "slot").agg(_first(negatives).alias("found"))
    pos = F.element_at("best", F.col("slot") + 1)
    return (top.join(best, "anchor_id").select("anchor_id", pos.alias("pos"), F.posexplode("found").alias("at", "neg"))
            .select("anchor_id", F.col("pos.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
                    F.col("neg.id").alias("negative_id"), (-F.col("pos.neg")).alias("positive_score"),
                    (-F.col("neg.neg")).alias("negative_score")))
