"""Operator 8: line quality by a linear-chain conditional random field.

Each line that holds a word is described by its own shape (length, capitals,
symbols, table bars, repeats, ...) and by its neighbours' shape; a two-state
chain labels the lines good or bad.  Labels exist per document only, so
training starts with all lines of a bad document bad, then lets the chain's
own marginals clear lines of bad documents, and trains again.  A document's
quality is the mean marginal of its lines, weighted by their length, put on
the probability scale by a logistic fit.  Trained in numpy on a bounded
sample of labelled rows; scoring runs in Arrow batches on all rows.

Cases: null and empty texts and texts without words have no lines and score
the share of good rows seen in training; a text of any length is read whole;
a single line has empty neighbours; repeated rows score alike; without
labelled rows of both classes every score is that (smoothed) share; no rows
give no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from evstat.llm.common import RangeHash, labelled_sample, text_slices, trained, word_bounds

TRAIN_ROWS = 3000          # labelled rows collected for training, by hash order
TRAIN_BYTES = 24_000_000
ROUNDS = 3                 # trainings; between them lines of bad documents are cleared
STEPS = 150
OWN = 12                   # shapes of one line
THRESHOLD = 0.5


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``lines x features``, the length of each line, and the first line of each text."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros((0, 3 * OWN + 1)), np.zeros(0), np.zeros(n + 1, np.int64)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    doc = np.repeat(np.arange(n), np.diff(first))
    new = np.ones(len(starts), bool)
    new[1:] = (feeds[starts[1:]] != feeds[starts[:-1]]) | (doc[1:] != doc[:-1])
    w0 = np.flatnonzero(new)                                  # first word of each line
    w1 = np.append(w0[1:], len(starts))
    lo, hi = starts[w0], ends[w1 - 1]
    line_doc = doc[w0]
    line_first = np.searchsorted(line_doc, np.arange(n + 1))
    length, words = (hi - lo).astype(float), (w1 - w0).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (c[hi] - c[lo]) / length

    def word_share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (c[w1] - c[w0]) / words

    special = np.zeros(256, bool)
    special[[ord(c) for c in "#*$%&<>@^~=+\\/{}[]_"]] = True
    ranges = RangeHash(data)
    h = ranges(starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & ~new[1:]
    # lines met before in the same text
    lh = np.stack([line_doc.astype(np.uint64), ranges(lo, hi)], axis=1)
    key = lh[:, 1] ^ (lh[:, 0] * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    before = np.ones(len(key))
    before[at] = 0
    final = data[ends - 1]
    own = np.stack([
        np.log1p(length) / 5, np.log1p(words) / 4, np.minimum(share((data >= 65) & (data <= 90)) * 4, 2),
        np.minimum(share(special[data]) * 6, 2), np.minimum(share(data == ord("|")) * 12, 2),
        np.minimum(share((data >= 48) & (data <= 57)) * 4, 2), np.minimum(share(data == ord("!")) * 8, 2),
        word_share(same), before, word_share(ends - starts == 1),
        np.minimum(np.bincount(np.repeat(np.arange(len(w0)), w1 - w0), ends - starts) / words / 8, 2),
        np.isin(final[w1 - 1], [ord(c) for c in ".?!:;"]).astype(float)], axis=1)
    prev, nxt = np.zeros_like(own), np.zeros_like(own)
    inner = line_doc[1:] == line_doc[:-1]
    prev[1:][inner] = own[:-1][inner]
    nxt[:-1][inner] = own[1:][inner]
    return np.concatenate([own, prev, nxt, np.ones((len(own), 1))], axis=1), length, line_first


@dataclass
class Model:
    unary: np.ndarray = field(default_factory=lambda: np.zeros(3 * OWN + 1))   # log odds of good
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))        # from, to
    scale: tuple[float, float] = (0.0, 0.0)                                    # slope, offset
    empty: float = 0.5


def _chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts ordered by falling number of lines, and those numbers."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    return order, n[order]


def marginals(model: Model, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all texts at once, line by line: P(good) of each line,
    the expected transitions, and the log partition sum."""
    order, n = _chains(first)
    score = np.stack([np.zeros(len(x)), x @ model.unary], axis=1)
    alpha, beta = np.zeros((len(x), 2)), np.zeros((len(x), 2))
    begin = first[:-1][order]
    for t in range(int(n.max(initial=0))):
        live = begin[:int(np.searchsorted(-n, -t, side="left"))] + t
        if t == 0:
            alpha[live] = score[live]
        else:
            alpha[live] = score[live] + np.logaddexp(alpha[live - 1, :1] + model.trans[0], alpha[live - 1, 1:] + model.trans[1])
    for t in range(int(n.max(initial=0)) - 2, -1, -1):
        live = begin[:int(np.searchsorted(-n, -(t + 1), side="left"))] + t
        after = score[live + 1] + beta[live + 1]
        beta[live] = np.logaddexp(after[:, :1] + model.trans[:, 0], after[:, 1:] + model.trans[:, 1])
    last = begin + n - 1
    log_z = np.zeros(len(first) - 1)
    log_z[order] = np.logaddexp(alpha[last, 0], alpha[last, 1])
    of = np.repeat(log_z, np.diff(first))
    good = np.exp(alpha[:, 1] + beta[:, 1] - of)
    inner = np.flatnonzero(np.diff(np.repeat(np.arange(len(first) - 1), np.diff(first))) == 0)
    moves = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            moves[i, j] = np.exp(alpha[inner, i] + model.trans[i, j] + score[inner + 1, j] + beta[inner + 1, j] - of[inner]).sum()
    return np.clip(good, 0, 1), moves, float(log_z.sum())


def _fit_chain(model: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> None:
    """Adam on the conditional log likelihood of the line labels ``y``."""
    inner = np.flatnonzero(np.diff(np.repeat(np.arange(len(first) - 1), np.diff(first))) == 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner], y[inner + 1]), 1)
    params, m, v = [model.unary, model.trans], [0.0, 0.0], [0.0, 0.0]
    for step in range(1, STEPS + 1):
        good, moves, _ = marginals(model, x, first)
        grads = [x.T @ (good - y) / len(x) + 1e-4 * model.unary, (moves - seen) / len(x) + 1e-4 * model.trans]
        for i, (p, g) in enumerate(zip(params, grads, strict=True)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            p -= 0.1 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)


def _mean(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each text (NaN without lines)."""
    weight, total = (np.concatenate([[0], np.cumsum(a)]) for a in (length, length * good))
    with np.errstate(invalid="ignore"):
        return np.diff(total[first]) / np.diff(weight[first])


def train(texts: list[str], labels: np.ndarray) -> Model:
    model = Model(empty=float((labels.sum() + 0.5) / (len(labels) + 1)) if len(labels) else 0.5)
    if len(set(labels.tolist())) < 2:
        return model
    # features of a slice at a time, so the driver never holds byte sums of the whole sample
    parts = [line_features(data, offsets) for _, _, data, offsets in text_slices(pa.array(texts, pa.string()), 500_000)]
    x, length = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    truth = labels[doc]
    y = truth.copy()
    for r in range(ROUNDS):
        _fit_chain(model, x, first, y)
        if r < ROUNDS - 1:
            good, _, _ = marginals(model, x, first)
            worst = np.full(len(texts), 2.0)
            np.minimum.at(worst, doc, good)
            y = np.where(truth == 1, 1, ((good > 0.5) & (good > worst[doc])).astype(truth.dtype))
    good, _, _ = marginals(model, x, first)
    q = _mean(good, length, first)
    has = ~np.isnan(q)
    a, b = 4.0, -2.0
    balance = np.where(labels[has] == 1, 1.0, max(1.0, (labels == 1).sum() / (labels == 0).sum()))
    for _ in range(100):                      # Newton steps of a logistic fit with a small prior
        p = 1 / (1 + np.exp(-(a * q[has] + b)))
        z = np.stack([q[has], np.ones(has.sum())], axis=1)
        grad = z.T @ (balance * (labels[has] - p)) - 0.1 * np.array([a, b])
        hess = (z * (balance * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.scale = (float(a), float(b))
    return model


def score_texts(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    x, length, first = line_features(data, offsets)
    good, _, _ = marginals(model, x, first)
    q = _mean(good, length, first)
    with np.errstate(over="ignore"):
        s = 1 / (1 + np.exp(-(model.scale[0] * q + model.scale[1])))
    return np.where(np.isnan(q) | (model.scale == (0.0, 0.0)), model.empty, s)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_BYTES) -> Model:
    """Train on a bounded sample of the labelled rows (see ``labelled_sample``)."""
    sample = labelled_sample(docs, labels, label, rows, text_bytes, doc_id, text)
    return trained(sample, lambda picked: train([p["text"] for p in picked], np.array([p["y"] for p in picked], dtype=np.int64)))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``<out>``: 0 to 1, higher where label 1 is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(model)      # some hundred numbers
    names = docs.columns
    t = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(t), 1_000_000):
                s = score_texts(shared.value, data, offsets)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(s)], names=[*names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))
