"""Operator 4: nearest neighbours by multiprobe p-stable hashing.

Vectors are brought to length 1; a table's bucket is the cell of a few
Gaussian projections of width ``cell``.  A query visits, in each table, the
``probes`` buckets of the smallest estimated cost: leaving a cell by a side
costs the squared distance to that side, and costs of several projections
add up.  Vectors of a bucket travel in blocks, queries that probe it in
blocks, and a block meets a block as one matrix product; a task keeps the
best of its blocks for each query, and a last aggregation merges tables.
Scores are cosines of the original vectors in double precision.

Cases: vectors that are null, empty, zero, or hold nulls or non-finite
components take no part; vectors of different lengths never meet; equal
vectors tie and the smaller id comes first; repeated rows of one id are one
candidate (the nearest row counts), and a query never meets rows of its own
id; a query whose probes meet fewer than ``k`` candidates is compared
with all vectors, so with fewer candidates all are returned; no rows give no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from evstat.llm.common import materialise, mix, rows_per_batch

TABLES = 3
PROJECTIONS = 5
CELL = 1.4
PROBES = 130
BLOCK = 512
STEPS = 2        # cells to either side that a probe may go


def _hashing(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1000 + dim)
    a = rng.standard_normal((TABLES * PROJECTIONS, dim))
    return a, rng.uniform(0, CELL, TABLES * PROJECTIONS)


def cells(unit: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """Position on every projection in units of a cell: ``n x tables x projections``."""
    a, b = _hashing(unit.shape[1])
    # lengths are 1, so projections have deviation 1 whatever the dimension
    return ((unit @ a.T + b) / CELL).reshape(len(unit), tables, PROJECTIONS)


def bucket_ids(cell: np.ndarray) -> np.ndarray:
    """One number for each integer cell (last axis)."""
    h = np.zeros(cell.shape[:-1], np.uint64)
    for j in range(cell.shape[-1]):
        h = mix(h * np.uint64(31) + cell[..., j].astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def _moves() -> np.ndarray:
    side = np.arange(-STEPS, STEPS + 1)
    return np.stack(np.meshgrid(*[side] * PROJECTIONS, indexing="ij"), axis=-1).reshape(-1, PROJECTIONS)


def probe_ids(pos: np.ndarray, probes: int) -> np.ndarray:
    """Buckets of one table to visit for each query, most promising first."""
    home = np.floor(pos)
    inside = pos - home                               # 0..1 within the cell
    moves = _moves()
    side = np.arange(-STEPS, STEPS + 1)
    # cost of ending ``s`` cells away: squared distance to that cell's nearer side
    cost = np.where(side > 0, side - inside[..., None], np.where(side < 0, inside[..., None] - side - 1, 0.0)) ** 2
    out = np.zeros((len(pos), min(probes, len(moves))), np.int64)
    for i in range(len(pos)):
        total = sum(cost[i, j][moves[:, j] + STEPS] for j in range(PROJECTIONS))
        best = np.argsort(total, kind="stable")[:out.shape[1]]
        out[i] = bucket_ids(home[i] + moves[best])
    return out


def _valid(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dim, ids, vectors)`` of the usable rows, by length of vector."""
    ids, col = batch.column(0), batch.column(1)
    if not len(col):
        return
    values = col.flatten().cast(pa.float64())
    flat = np.array(values.to_numpy(zero_copy_only=False), dtype=np.float64)      # nulls become NaN
    length = np.array([0 if x is None else x for x in pa.compute.list_value_length(col).to_pylist()])
    start = np.cumsum(length) - length
    known = np.array([x is not None for x in ids.to_pylist()])
    for dim in np.unique(length[(length > 0) & known]):
        rows = np.flatnonzero((length == dim) & known)
        v = flat[start[rows][:, None] + np.arange(dim)]
        norm = np.sqrt((v * v).sum(1))
        ok = np.isfinite(v).all(1) & (norm > 0) & np.isfinite(norm)
        if ok.any():
            yield int(dim), ids.take(pa.array(rows[ok])).to_numpy().astype(np.int64), v[ok]


_BLOCKS = "dim int, tab int, bucket long, ids array<long>, vectors binary"


def _blocks(dim: int, tab: int, bucket: np.ndarray, row: np.ndarray, ids: np.ndarray, v: np.ndarray, kind: str) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket, row = bucket[order], row[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    out: list[tuple] = []
    for a, b in zip(edge, np.append(edge[1:], len(bucket)), strict=True):
        for lo in range(a, b, BLOCK):
            r = row[lo:min(b, lo + BLOCK)]
            out.append((int(bucket[a]), ids[r].tolist(), v[r].astype(kind).tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array([dim] * len(out), pa.int32()), pa.array([tab] * len(out), pa.int32()), pa.array([o[0] for o in out], pa.int64()),
         pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.binary())],
        names=["dim", "tab", "bucket", "ids", "vectors"])


def _index(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, v in _valid(batch):
                unit = v / np.sqrt((v * v).sum(1, keepdims=True))
                b = bucket_ids(np.floor(cells(unit)))
                for t in range(TABLES):
                    yield _blocks(dim, t, b[:, t], np.arange(len(ids)), ids, v, kind)
    return run


def _probe(probes: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, v in _valid(batch):
                unit = v / np.sqrt((v * v).sum(1, keepdims=True))
                pos = cells(unit)
                for t in range(TABLES):
                    b = probe_ids(pos[:, t], probes)
                    yield _blocks(dim, t, b.ravel(), np.repeat(np.arange(len(ids)), b.shape[1]), ids, v, kind)
    return run


_FOUND = "query_id long, vec_id long, score double"


def _best(queries: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The best ``k`` distinct ids of each query."""
    order = np.lexsort((ids, -score, queries))
    queries, ids, score = queries[order], ids[order], score[order]
    pair = np.stack([queries, ids], axis=1)
    _, at = np.unique(pair, axis=0, return_index=True)          # the same pair from several tables
    at = np.sort(at)
    queries, ids, score = queries[at], ids[at], score[at]
    new = np.concatenate([[True], queries[1:] != queries[:-1]]) if len(queries) else np.zeros(0, bool)
    run = np.flatnonzero(new)
    rank = np.arange(len(queries)) - np.repeat(run, np.diff(np.append(run, len(queries))))
    keep = rank < k
    return queries[keep], ids[keep], score[keep]


def _rank(k: int, kind: str, hold: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            return _best(*[np.concatenate(x) for x in zip(*parts, strict=True)], k)

        def out(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for dim, qid, qv, cid, cv in zip(*[batch.column(i) for i in range(5)], strict=True):
                dim = dim.as_py()
                qi, ci = np.array(qid.as_py(), np.int64), np.array(cid.as_py(), np.int64)
                q = np.frombuffer(qv.as_buffer(), kind).reshape(-1, dim).astype(np.float64)
                c = np.frombuffer(cv.as_buffer(), kind).reshape(-1, dim).astype(np.float64)
                near = (q / np.sqrt((q * q).sum(1, keepdims=True))) @ (c / np.sqrt((c * c).sum(1, keepdims=True))).T
                near[qi[:, None] == ci] = -np.inf
                # all that could be among the best k up to rounding, then their exact scores
                if near.shape[1] > k:
                    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
                else:
                    least = np.full(len(near), -2.0)
                i, j = np.nonzero((near >= least[:, None] - 1e-9) & np.isfinite(near))
                if len(i):
                    s = _pair_cosines(q[i], c[j])
                    parts.append(_best(qi[i], ci[j], s, k))
                if sum(len(p[0]) for p in parts) > hold:
                    parts[:] = [merged()]
                    if len(parts[0][0]) > hold // 2:
                        yield out(parts[0])
                        parts.clear()
        if parts:
            yield out(merged())
    return run


def _pair_cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (q * c).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((c * c).sum(1)))


def nearest(index: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", *,
            k: int = 5, probes: int = PROBES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, best first."""
    pick = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    # components travel in the precision that the table has; all sums are double
    kind = "<f4" if index.schema[vector].dataType == queries.schema[vector].dataType == ArrayType(FloatType()) else "<f8"
    blocks = materialise(pick(index).mapInArrow(_index(kind), _BLOCKS), "ann-index")
    asked = materialise(pick(queries).mapInArrow(_probe(probes, kind), _BLOCKS), "ann-queries")
    found = _meet(asked, blocks, ["dim", "tab", "bucket"], k, kind)
    # queries whose probes met fewer than k candidates meet all blocks of one table
    enough = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k)
    first = asked.where("tab = 0").select("dim", F.explode(F.array_distinct("ids")).alias("query_id")).distinct()
    short = materialise(first.join(enough, "query_id", "left_anti"), "ann-short")
    if short.limit(1).count():
        whole = pick(queries).join(short.select("query_id").distinct(), F.col("id") == F.col("query_id"), "left_semi")
        found = found.union(_meet(whole.mapInArrow(_probe(1, kind), _BLOCKS).where("tab = 0"), blocks.where("tab = 0"),
                                  ["dim"], k, kind))
    # at most k rows a query and task; the largest of them, ties to the smaller id
    best: Column = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), F.col("vec_id").alias("id")))), 1, k)
    out = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id").agg(best.alias("best"))
    return out.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.neg")).alias("score"))


def _meet(asked: DataFrame, blocks: DataFrame, on: list[str], k: int, kind: str) -> DataFrame:
    q = asked.select(*on, F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    met = q.join(blocks.select(*on, "ids", "vectors"), on).select("dim", "query_ids", "query_vectors", "ids", "vectors")
    with rows_per_batch(asked.sparkSession, 32):
        return materialise(met.mapInArrow(_rank(k, kind), _FOUND), "ann-found")
