"""Operator 10: toxicity by a convolutional text classifier.

A word is the sum of hashed embeddings (the word and its first three, four
and five bytes, so inflected forms meet); filters of several widths run over
the words, each filter's maximum over the whole text is a feature, and a
logistic layer gives the score.  Trained in numpy on all labelled rows: they
are dealt into shards by hash, in each epoch every shard trains from the same
weights, and the means of the shards' weights, formed by Spark block by block,
start the next epoch.  Rows that fit one shard train at once.  Scoring runs in Arrow batches on all rows.
Thresholds per language are calibrated on the scores of all training rows; the
language never enters the score.

Cases: null and empty texts get the score of no features (the bias);
texts shorter than a filter are padded with one zero word on each side, as
all texts are; a text of any length is scored whole, in bounded pieces;
repeated rows score alike; without labelled rows of both classes the score
is the smoothed share of toxic rows; no rows give no rows; a null or unseen
language uses the threshold fitted over all languages; other columns pass
through.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from evstat.llm.common import RangeHash, labelled_rows, materialise, rows_per_batch, text_slices, trained, word_bounds

SHARD_ROWS = 3000          # labelled rows that train together, about
SHARD_BYTES = 24_000_000   # and their text, whichever is less
TINY = 1e-30               # smaller weights and moments are zero
BLOCK = 1024               # buckets whose weights are added up in one row
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5)
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
DROPOUT = 0.3            # of the words of a text, anew in every training step
RARE = 4.0               # a bucket seen in so few texts counts half
EPOCHS = 6
ENOUGH = 0.02             # mean loss of all rows in an epoch after which shards train no further
THRESHOLD = 0.7
_PIECE = 50_000            # words convolved at once


def word_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """``words x (1 + prefixes)`` embedding rows (lower-cased ASCII letters, edge marks
    dropped), and the first word of each text."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    starts, ends, first = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), first
    # trailing punctuation is not part of a word
    letter = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    for _ in range(4):
        ends = np.where((ends - starts > 1) & ~letter[ends - 1], ends - 1, ends)
    h = RangeHash(data)
    cols = [h(starts, ends)] + [h(starts, np.minimum(ends, starts + p)) ^ np.uint64(p * 0x9E3779B9) for p in PREFIXES]
    return np.stack([(c % np.uint64(buckets)).astype(np.int64) for c in cols], axis=1), first


@dataclass
class Model:
    """Weights of the network; ``b`` alone decides when there is nothing to learn from."""
    emb: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, DIM), np.float32))
    conv: list[np.ndarray] = field(default_factory=list)     # width*dim x filters
    cbias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    limits: dict[str | None, float] = field(default_factory=dict)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _convolve(x: np.ndarray, width: int, kernel: np.ndarray) -> np.ndarray:
    """Every filter at every run of ``width`` neighbouring words."""
    n, dim = len(x) - width + 1, x.shape[1]
    z = x[:n] @ kernel[:dim]
    for j in range(1, width):
        z += x[j:j + n] @ kernel[j * dim:(j + 1) * dim]
    return z


def _features(model: Model, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Max-pooled features of one text, the words that gave them, and its word vectors."""
    x = np.zeros((len(rows) + 2, model.emb.shape[1]), np.float32)
    if len(rows):
        x[1:-1] = model.emb[rows[:, 0]]
        for c in range(1, rows.shape[1]):
            x[1:-1] += model.emb[rows[:, c]]
    feats, where = [], []
    for w, k, b in zip(WIDTHS, model.conv, model.cbias, strict=True):
        if len(x) < w:
            x = np.concatenate([x, np.zeros((w - len(x), x.shape[1]), np.float32)])
        z = _convolve(x, w, k)
        at = z.argmax(0)
        where.append(at)
        feats.append(np.maximum(z[at, np.arange(k.shape[1])] + b, 0))
    return np.concatenate(feats), where, x


def _held(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """In how many texts of each label a bucket is."""
    held = np.zeros((2, BUCKETS))
    for rows, y in zip(docs, labels, strict=True):
        held[y, np.unique(rows)] += 1
    return held


def _log_odds(held: np.ndarray, negative: int, positive: int) -> np.ndarray:
    """How much oftener texts of label 1 hold a bucket, pulled to zero where it is rare:
    the first dimension of the embeddings starts from it."""
    odds = np.log((held[1] + 1) / (positive + 2)) - np.log((held[0] + 1) / (negative + 2))
    seen = held.sum(0)
    return (odds * seen / (seen + RARE) / (1 + len(PREFIXES))).astype(np.float32)


@dataclass
class _Adam:
    """The optimiser's memory: moments of the dense weights (all but the bias), squared gradients of the buckets."""
    mom: list[np.ndarray]
    var: list[np.ndarray]
    emb_var: np.ndarray
    step: int = 0

    @staticmethod
    def of(m: Model) -> _Adam:
        return _Adam([np.zeros_like(p) for p in _dense(m)], [np.zeros_like(p) for p in _dense(m)], np.zeros(BUCKETS, np.float32))


def _dense(m: Model) -> list[np.ndarray]:
    return [*m.conv, *m.cbias, m.out]


def _initial(n: int, positive: int, rng: np.random.Generator) -> Model:
    """Random weights, the bias of the share of label 1; without both labels the bias decides alone."""
    share = (positive + 0.5) / (n + 1) if n else 0.5
    n_feat = FILTERS * len(WIDTHS)
    m = Model(emb=rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32),
              conv=[rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
              cbias=[np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS],
              out=np.zeros(n_feat, np.float32), bias=float(np.log(share / (1 - share))))
    if 0 < positive < n:
        m.out = rng.normal(0, 0.1, n_feat).astype(np.float32)
    return m


def _settle(weights: list[np.ndarray]) -> None:
    """A filter that no text moves decays; as a denormal number it would slow every product some fifty times."""
    for w in weights:
        w[np.abs(w) < TINY] = 0


def _bucket_docs(texts: list[str]) -> list[np.ndarray]:
    out = []
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        out.append(word_buckets(b, np.array([0, len(b)]))[0].astype(np.int32))
    return out


def _weight(n: int, positive: int) -> float:
    """What a text of label 1 counts."""
    return min(4.0, max(1.0, (n - positive) / max(positive, 1) / 2))


def _epoch(m: Model, adam: _Adam, docs: list[np.ndarray], labels: np.ndarray, heavy: float, epoch: int,
           rng: np.random.Generator) -> float:
    """Adam on the logistic loss over all texts once, one a step, gradients through the maxima only.  Returns the
    sum of the losses that the texts met."""
    loss = 0.0
    weight = np.where(labels == 1, heavy, 1.0)
    params, mom, var, emb_var = _dense(m), adam.mom, adam.var, adam.emb_var
    rate = 0.01 / (1 + 0.6 * epoch)
    for i in rng.permutation(len(docs)):
        rows = docs[i][rng.random(len(docs[i])) >= DROPOUT]
        f, where, x = _features(m, rows)
        p = _sigmoid(np.array(f @ m.out + m.bias))
        loss -= math.log(max(1e-12, float(p if labels[i] else 1 - p)))
        g = float((p - labels[i]) * weight[i])
        if abs(g) < 1e-3:
            continue
        adam.step += 1
        step = adam.step
        grads_k, grads_b, gx = [], [], {}
        gf = g * m.out * (f > 0)
        for j, w in enumerate(WIDTHS):
            gj = gf[j * FILTERS:(j + 1) * FILTERS]
            win = x[where[j][:, None] + np.arange(w)].reshape(FILTERS, w * DIM)
            grads_k.append((win * gj[:, None]).T + 1e-4 * m.conv[j])
            grads_b.append(gj)
            back = (m.conv[j] * gj).T.reshape(FILTERS, w, DIM)
            for q in np.flatnonzero(gj):
                for o in range(w):
                    r = where[j][q] + o - 1
                    if 0 <= r < len(rows):
                        gx[r] = gx.get(r, 0) + back[q, o]
        for q, (param, grad) in enumerate(zip(params, [*grads_k, *grads_b, g * f + 1e-4 * m.out], strict=True)):
            mom[q] += 0.1 * (grad - mom[q])
            var[q] += 0.01 * (grad * grad - var[q])
            hat = mom[q] / (1 - 0.9 ** step), var[q] / (1 - 0.99 ** step)
            param -= rate * hat[0] / (np.sqrt(hat[1]) + 1e-6)
        m.bias -= rate * g
        for r, grad in gx.items():
            at = rows[r]
            emb_var[at] += float(grad @ grad)
            m.emb[at] -= (0.02 / np.sqrt(1e-4 + emb_var[at]))[:, None] * grad
        if step % 32 == 0:
            _settle([*params, *mom, *var])
    _settle([*params, *mom, *var])
    return loss


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """All epochs over rows that one task holds."""
    rng = np.random.default_rng(seed)
    n, positive = len(labels), int(labels.sum())
    m = _initial(n, positive, rng)
    if not 0 < positive < n:
        return m
    docs = _bucket_docs(texts)
    m.emb[:, 0] = _log_odds(_held(docs, labels), n - positive, positive)
    adam = _Adam.of(m)
    for epoch in range(EPOCHS):
        _epoch(m, adam, docs, labels, _weight(n, positive), epoch, rng)
    return m


# ---------------------------------------------------------------- training on shards

def _blocks(table: np.ndarray, task: int) -> Iterator[pa.RecordBatch]:
    """A table of one line a bucket in blocks, so that their sums are spread over tasks."""
    for at in range(0, BUCKETS, BLOCK):
        yield pa.RecordBatch.from_arrays(
            [pa.array([at // BLOCK], pa.int32()), pa.array([task], pa.int64()),
             pa.array([np.ascontiguousarray(table[at:at + BLOCK], np.float64).tobytes()], pa.binary())], schema=_SUMS)


def _block_sums(parts: DataFrame, finish: Callable[[np.ndarray], np.ndarray], width: int, columns: int) -> tuple[np.ndarray, list[bytes]]:
    """The tables of all tasks added block by block, and what ``finish`` makes of each sum as one array; lines of block
    -1 come as they are.  Only lines of the table that are not zero travel to the driver."""
    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")
        block = group.column(0)[0].as_py()
        if block < 0:
            return group.select(["block", "payload"]).append_column("at", pa.nulls(len(group), pa.binary()))
        total = np.zeros(BLOCK * width)
        for x in group.column(2):
            total += np.frombuffer(x.as_buffer(), np.float64)
        done = finish(total.reshape(BLOCK, width)).astype(np.float32)
        at = np.flatnonzero(done.any(1)).astype(np.int32)
        return pa.table({"block": pa.array([block], pa.int32()), "payload": pa.array([done[at].tobytes()], pa.binary()),
                         "at": pa.array([at.tobytes()], pa.binary())})

    with rows_per_batch(parts.sparkSession, 500):       # a task holds one shard of texts, not a default batch besides
        got = parts.groupBy("block").applyInArrow(add, "block int, payload binary, at binary").collect()
    table, lines = np.zeros((BUCKETS, columns), np.float32), []
    while got:                                          # the driver holds one copy of the table
        block, payload, at = got.pop()
        if block < 0:
            lines.append(bytes(payload))
        else:
            table[block * BLOCK + np.frombuffer(at, np.int32)] = np.frombuffer(payload, np.float32).reshape(-1, columns)
    return table, sorted(lines)


_SUMS = pa.schema([("block", pa.int32()), ("task", pa.int64()), ("payload", pa.binary())])
_SUMS_SQL = "block int, task long, payload binary"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """``shard, texts, labels`` of rows that come ordered by shard; one of twice the usual size comes in pieces."""
    shard, texts, labels, size = None, [], [], 0
    for batch in batches:
        for s, y, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if texts and (s != shard or len(texts) >= 2 * SHARD_ROWS or size >= 2 * SHARD_BYTES):
                yield shard, texts, np.array(labels, np.int64)
                texts, labels, size = [], [], 0
            shard = s
            size += len(t)
            texts.append(t)
            labels.append(y)
    if texts:
        yield shard, texts, np.array(labels, np.int64)


def _count_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, first = np.zeros((BUCKETS, 2)), None
    for shard, texts, labels in _shards(batches):
        first = shard if first is None else first
        held += _held(_bucket_docs(texts), labels).T
    if first is not None:
        yield from _blocks(held, first)


def _train_shards(shared, heavy: float, epoch: int, seed: int):
    """Each shard trains one epoch from the shared weights; a task adds up how far its shards moved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for shard, texts, labels in _shards(batches):
            if first is None:
                start, before = _unpacked(shared.value)
                # of a bucket: steps of its weights and squared gradients, and the shards that moved it
                first, moved, dense, rows = shard, np.zeros((BUCKETS, DIM + 2), np.float32), 0.0, 0
                loss = 0.0
            m = replace(start, emb=start.emb.copy(), conv=[x.copy() for x in start.conv],
                        cbias=[x.copy() for x in start.cbias], out=start.out.copy())
            adam = _Adam([x.copy() for x in before.mom], [x.copy() for x in before.var], before.emb_var.copy(), before.step)
            loss += _epoch(m, adam, _bucket_docs(texts), labels, heavy, epoch, np.random.default_rng((seed, epoch, shard)))
            at = np.flatnonzero(adam.emb_var != before.emb_var)
            moved[at, :DIM] += m.emb[at] - start.emb[at]
            moved[at, DIM] += adam.emb_var[at] - before.emb_var[at]
            moved[at, DIM + 1] += 1
            dense = dense + len(labels) * _flat(m, adam)
            rows += len(labels)
        if first is not None:
            yield from _blocks(moved, first)
            payload = np.concatenate([[rows, loss], dense]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([first], pa.int64()), pa.array([payload], pa.binary())],
                                             schema=_SUMS)
    return run


def _flat(m: Model, adam: _Adam) -> np.ndarray:
    return np.concatenate([x.ravel().astype(np.float64) for x in [*_dense(m), *adam.mom, *adam.var]] + [[m.bias, adam.step]])


def _set_flat(m: Model, adam: _Adam, flat: np.ndarray) -> None:
    at = 0
    for x in [*_dense(m), *adam.mom, *adam.var]:
        x[...] = flat[at:at + x.size].reshape(x.shape)
        at += x.size
    m.bias, adam.step = float(flat[-2]), round(flat[-1])


def _unseen(n: int, positive: int, seed: int) -> Model:
    """The initial weights where no text holds any bucket: log odds of zero."""
    m = _initial(n, positive, np.random.default_rng(seed))
    m.emb[:, 0] = 0
    return m


def _packed(m: Model, adam: _Adam, unseen: Model, drawn: tuple[int, int, int]) -> tuple:
    """Model and optimiser as a task gets them: only buckets that differ from ``unseen``, which a task draws again."""
    at = np.flatnonzero((m.emb != unseen.emb).any(1) | (adam.emb_var != 0))
    return drawn, at.astype(np.int32), m.emb[at], adam.emb_var[at], _flat(m, adam)


def _unpacked(packed: tuple) -> tuple[Model, _Adam]:
    drawn, at, emb, emb_var, flat = packed
    m = _unseen(*drawn)
    adam = _Adam.of(m)
    m.emb[at], adam.emb_var[at] = emb, emb_var
    _set_flat(m, adam, flat)
    return m, adam


def _mean_moves(total: np.ndarray) -> np.ndarray:
    return total[:, :-1] / np.maximum(total[:, -1:], 1)


@contextmanager
def _shared(spark: SparkSession, value: object) -> Iterator[Broadcast]:
    """``value`` as a broadcast for what runs to its end inside; then no copy stays, the driver's included."""
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()


def _train_sharded(rows: DataFrame, n: int, positive: int, seed: int = 7) -> Model:
    """``shard, y, text`` in files ordered by shard, whatever their number: in each epoch every shard trains from the
    same weights, whose next values are the means of the shards'; a bucket's, of those shards that moved it.  The
    last epoch is the first one whose mean loss over all rows is below ``ENOUGH``, the sixth at most."""
    spark = rows.sparkSession
    m = _initial(n, positive, np.random.default_rng(seed))
    if not 0 < positive < n:
        return m
    odds, _ = _block_sums(rows.mapInArrow(_count_shards, _SUMS_SQL), lambda held: _log_odds(held.T, n - positive, positive)[:, None], 2, 1)
    m.emb[:, 0] = odds[:, 0]
    adam, unseen = _Adam.of(m), _unseen(n, positive, seed)
    for epoch in range(EPOCHS):
        with _shared(spark, _packed(m, adam, unseen, (n, positive, seed))) as shared:
            moves, dense = _block_sums(rows.mapInArrow(_train_shards(shared, _weight(n, positive), epoch, seed), _SUMS_SQL),
                                       _mean_moves, DIM + 2, DIM + 1)
        m.emb += moves[:, :DIM]
        adam.emb_var += moves[:, DIM]
        del moves
        total = sum(np.frombuffer(x, np.float64) for x in dense)
        _set_flat(m, adam, total[2:] / total[0])
        if total[1] < ENOUGH * total[0]:
            break
    return m


def score_texts(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows, first = word_buckets(data, offsets)
    n = len(offsets) - 1
    feats = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    a = 0
    while a < n:
        # texts up to a bound of words together; a longer one in pieces that overlap
        b = int(np.searchsorted(first, first[a] + _PIECE, side="right")) - 1
        b = min(n, max(b, a + 1))
        if b == a + 1 and first[b] - first[a] > _PIECE:
            for lo in range(int(first[a]), int(first[b]), _PIECE):
                hi = min(int(first[b]), lo + _PIECE + max(WIDTHS))
                feats[a] = np.maximum(feats[a], _features(model, rows[lo:hi])[0])
        else:
            feats[a:b] = _pooled(model, rows[first[a]:first[b]], first[a:b + 1] - first[a])
        a = b
    return _sigmoid(feats @ model.out + model.bias)


def _pooled(model: Model, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of several texts at once: zero words stand between them."""
    n = len(first) - 1
    gap = max(WIDTHS) - 1
    at = first + np.arange(n + 1) * gap + gap
    x = np.zeros((int(at[-1]) + gap, model.emb.shape[1]), np.float32)
    if len(rows):
        doc = np.repeat(np.arange(n), np.diff(first))
        place = np.arange(len(rows)) + doc * gap + gap
        x[place] = model.emb[rows[:, 0]]
        for c in range(1, rows.shape[1]):
            x[place] += model.emb[rows[:, c]]
    out = []
    for w, k, b in zip(WIDTHS, model.conv, model.cbias, strict=True):
        z = _convolve(x, w, k)
        # the windows of a text start at the zero word before it and end at the one after it
        lo = np.minimum(at[:-1] - 1, len(z) - 1)
        hi = np.minimum(at[:-1] + np.diff(first) + 2 - w, len(z))
        hi = np.maximum(hi, lo + 1)
        best = np.maximum.reduceat(np.concatenate([z, z[-1:]]), np.stack([lo, hi], 1).ravel())[::2]
        out.append(np.maximum(best + b, 0))
    return np.concatenate(out, axis=1)


GRID = np.round(np.arange(0.3, 0.951, 0.025), 3)


def _best_limit(above: np.ndarray, positive: int, negative: int, start: float) -> float:
    """``above``: rows of label 0 and 1 with a score of each limit of the grid or more."""
    if not positive or not negative:
        return start
    f1 = 2 * above[1] / np.maximum(1, above.sum(0) + positive)
    top = GRID[f1 >= max(f1) - 1e-12]
    return float(top[np.argmin(np.abs(top - start))])


def _limits(counts: dict[tuple[str | None, int], np.ndarray], start: float = THRESHOLD) -> dict:
    """``(language, label)`` to the number of rows by how many limits of the grid their score reaches."""
    def best(langs: set) -> float:
        n = np.stack([sum((c for (x, y), c in counts.items() if y == of and x in langs), np.zeros(len(GRID) + 1, np.int64)) for of in (0, 1)])
        return _best_limit(n[:, ::-1].cumsum(1)[:, ::-1][:, 1:], n[1].sum(), n[0].sum(), start)
    langs = {x for x, _ in counts}
    return {None: best(langs)} | {x: best({x}) for x in sorted(langs - {None, ""})}


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str | None], start: float = THRESHOLD) -> dict:
    """Threshold of each language (and of all, under None): the one with the best F1 on
    the training rows, nearest to ``start`` among equals; ``start`` without both labels."""
    counts: dict = {}
    for s, y, lang in zip(np.searchsorted(GRID, scores, side="right"), labels, langs, strict=True):
        counts.setdefault((lang, int(y)), np.zeros(len(GRID) + 1, np.int64))[s] += 1
    return _limits(counts, start)


def _calibrated(rows: DataFrame, model: Model) -> Model:
    """The thresholds from the scores of all rows ``y, text, lang``, counted by language, label and limits reached."""
    model.limits = {None: THRESHOLD}
    reached = sum((F.col("score") >= float(x)).cast("int") for x in GRID)
    counts: dict = {}
    with _shared(rows.sparkSession, model) as shared:
        scored = _scored(rows.select("y", "text", "lang"), shared, "text", "lang", "score")
        found = scored.groupBy("lang", "y", reached.alias("reached")).count().collect()
    for r in found:
        counts.setdefault((r["lang"], r["y"]), np.zeros(len(GRID) + 1, np.int64))[r["reached"]] += r["count"]
    model.limits = _limits(counts)
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        lang: str = "lang", rows: int = SHARD_ROWS, text_bytes: int = SHARD_BYTES) -> Model:
    """Train and calibrate on all labelled rows: in one task where ``rows`` and ``text_bytes`` hold them, else in
    shards of about that size."""
    def train_and_calibrate(picked: list[dict]) -> Model:
        labels_ = np.array([p["y"] for p in picked], dtype=np.int64)
        model = train([p["text"] for p in picked], labels_)
        slices = text_slices(pa.array([p["text"] for p in picked], pa.string()), 500_000)
        scores = np.concatenate([np.zeros(0), *(score_texts(model, data, offsets) for _, _, data, offsets in slices)])
        model.limits = calibrate(scores, labels_, [p["lang"] for p in picked])
        return model

    every = labelled_rows(docs, labels, label, doc_id, text, lang)
    size = every.agg(F.count("*").alias("n"), F.sum("y").alias("positive"), F.sum("bytes").alias("bytes")).first()
    shards = max(-(-size["n"] // rows), -(-(size["bytes"] or 0) // text_bytes))
    if shards <= 1:
        return trained(every, train_and_calibrate)
    dealt = labelled_rows(docs, labels, label, doc_id, text, lang, partitions=shards).withColumn("shard", F.spark_partition_id())
    dealt = materialise(dealt.sortWithinPartitions("h", "y", "text").select("shard", "y", "text", "lang"), "toxic-shards")
    return _calibrated(dealt, _train_sharded(dealt.select("shard", "y", "text"), size["n"], size["positive"]))


def score(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", out: str = "score") -> DataFrame:
    """``docs`` without its text column's copy: all columns, then ``<out>`` (0 to 1) and
    ``<out>_limit`` (the threshold of the row's language)."""
    return _scored(docs, docs.sparkSession.sparkContext.broadcast(model), text, lang, out)     # fixed size: BUCKETS x DIM floats


def _scored(docs: DataFrame, shared: Broadcast, text: str, lang: str, out: str) -> DataFrame:
    names = docs.columns
    t, g = names.index(text), names.index(lang) if lang in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(t)):
                s = score_texts(m, data, offsets)
                part = batch.slice(a, b - a)
                of = part.column(g).to_pylist() if g is not None else [None] * (b - a)
                limit = [m.limits.get(x, m.limits[None]) for x in of]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s.astype(np.float64)), pa.array(limit, pa.float64())],
                                                 names=[*names, out, f"{out}_limit"])

    schema = StructType([*docs.schema.fields, StructField(out, DoubleType()), StructField(f"{out}_limit", DoubleType())])
    return docs.mapInArrow(run, schema)
