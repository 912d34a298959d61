"""Operator 2: quality by a linear-chain conditional random field over the lines of a text.

Every line is good or bad.  A line's features are shape measures of itself and of the lines before
and after it; the chain adds a weight for each pair of neighbouring labels.  Training lines carry
their document's label.  The marginals of forward-backward, weighted by line length, give the
document's share of good text, which a two-parameter logistic curve turns into its score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.llm import arrays as A
from kinfold.llm.arrays import U
from kinfold.llm.common import to_batch
from kinfold.llm.rules import _LEAD, _LOWER, _SYMBOL, _UPPER

#: At most so many labelled documents are used for the fit, chosen by a hash of their id.
TRAIN_DOCS = 3000
FOLDS, THRESHOLD = 5, 0.3
STEPS, RATE, SHRINK = 150, 0.1, 1e-3
_NEWLINE = A.word_class("\n")
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_BANG = np.array([b in b"!?" for b in range(256)])
_PIPE = np.array([b in b"|\t" for b in range(256)])
N_SHAPES = 14


def line_features(data: np.ndarray, off: np.ndarray):
    """(row, characters, features) of every line with a word; features include both neighbours'."""
    s, e, rows = A.spans(data, off, _NEWLINE)
    ws, we, wrow = A.spans(data, off, A.NOT_SPACE)
    a, b = np.searchsorted(ws, s), np.searchsorted(ws, e)
    real = b > a
    s, e, rows, a, b = s[real], e[real], rows[real], a[real], b[real]
    n = len(s)
    if not n:
        return rows, np.zeros(0), np.zeros((0, 3 * N_SHAPES + 3), np.float32)

    def total(flags: np.ndarray, x=None, y=None) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags)])
        return (c[e if y is None else y] - c[s if x is None else x]).astype(np.float64)

    chars, words = total(_LEAD[data]), (b - a).astype(np.float64)
    upper, lower = total(_UPPER[data]), total(_LOWER[data])
    p = A.prefix(data, A.VALUES_LOWER)
    h = A.span_hash(p, ws, we)
    same = np.append(False, (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1]))
    at, g = A.windows(h, wrow, 3)
    again = np.zeros(len(ws), bool)
    if len(at):
        _, inverse, count = np.unique(A.mix(g + A.mix(wrow[at].astype(U))), return_inverse=True, return_counts=True)
        for i in range(3):
            again[at[count[inverse] > 1] + i] = True
    key = A.mix(A.span_hash(p, s, e) + A.mix(rows.astype(U)))
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    copy = first[inverse] != np.arange(n)
    shape = np.stack([
        np.log1p(chars), np.log1p(words), upper / (upper + lower + 1), total(_SYMBOL[data]) / words,
        total(_BANG[data]) / words, total(_PIPE[data]) / words, total(_DIGIT[data]) / chars,
        total(same, a, b) / words, total(again, a, b) / words, copy.astype(np.float64), np.log1p(chars / words),
        (data[e - 1] == ord(".")).astype(np.float64), total(~_LEAD[data]) / chars,
        _UPPER[data[ws[a]]].astype(np.float64),
    ], axis=1).astype(np.float32)
    before, after = np.zeros((n, N_SHAPES + 1), np.float32), np.zeros((n, N_SHAPES + 1), np.float32)
    chained = np.flatnonzero(rows[1:] == rows[:-1])
    before[chained + 1, :-1], before[chained + 1, -1] = shape[chained], 1
    after[chained, :-1], after[chained, -1] = shape[chained + 1], 1
    return rows, chars, np.concatenate([shape, before, after, np.ones((n, 1), np.float32)], axis=1)


class Chains:
    """Lines of many texts laid out as a (time x text) grid, the longest texts first."""

    def __init__(self, rows: np.ndarray):
        self.rows, first, size = np.unique(rows, return_index=True, return_counts=True)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.time = np.arange(len(rows)) - np.repeat(first, size)
        self.text = np.repeat(place, size)
        self.size = size[order]
        self.active = [int(np.searchsorted(-self.size, -t, "left")) for t in range(int(self.size[0]) if len(size) else 0)]

    def marginals(self, unary: np.ndarray, pair: np.ndarray):
        """Probability that each line is good, and expected label pairs (2 x 2)."""
        steps, width = len(self.active), len(self.size)
        u = np.zeros((steps, width, 2))
        u[self.time, self.text, 1] = unary
        f, g = np.zeros_like(u), np.zeros_like(u)
        f[0] = u[0]
        for t in range(1, steps):
            k = self.active[t]
            f[t, :k] = u[t, :k] + np.logaddexp(f[t - 1, :k, :1] + pair[0], f[t - 1, :k, 1:] + pair[1])
        expected = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            k = self.active[t + 1]
            x = u[t + 1, :k] + g[t + 1, :k]
            g[t, :k] = np.logaddexp(x[:, :1] + pair[:, 0], x[:, 1:] + pair[:, 1])
            z = np.logaddexp(f[t, :k, 0] + g[t, :k, 0], f[t, :k, 1] + g[t, :k, 1])
            for i in (0, 1):
                for j in (0, 1):
                    expected[i, j] += np.exp(f[t, :k, i] + pair[i, j] + x[:, j] - z).sum()
        b = (f + g)[self.time, self.text]
        return 1 / (1 + np.exp(np.clip(b[:, 0] - b[:, 1], -60, 60))), expected


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pair: np.ndarray
    slope: float
    shift: float
    prior: float

    def shares(self, rows: np.ndarray, chars: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """Length-weighted share of good lines of each of ``n`` texts; the prior where there is none."""
        out = np.full(n, self.prior)
        if len(rows):
            good, _ = Chains(rows).marginals(((x - self.mean) / self.scale) @ self.weights, self.pair)
            total = np.bincount(rows, weights=chars, minlength=n)
            share = np.bincount(rows, weights=chars * good, minlength=n)
            out[total > 0] = share[total > 0] / total[total > 0]
        return out

    def score(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * share + self.shift, -30, 30)))


def _adam(gradient, start: np.ndarray, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return x


def train(rows: np.ndarray, chars: np.ndarray, x: np.ndarray, label: np.ndarray) -> Model:
    """Fit on lines of documents numbered by ``rows``; ``label`` is 0 or 1 for each document."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    z, y = ((x - mean) / scale).astype(np.float64), label[rows].astype(np.float64)
    chains, k, n = Chains(rows), x.shape[1], len(rows)
    link = rows[1:] == rows[:-1]
    seen = np.array([[((1 - y[1:]) * (1 - y[:-1]))[link].sum(), 0], [0, (y[1:] * y[:-1])[link].sum()]])

    def gradient(w):
        good, expected = chains.marginals(z @ w[:k], w[k:].reshape(2, 2))
        return np.concatenate([z.T @ (good - y), (expected - seen).ravel()]) / n + SHRINK * w

    w = _adam(gradient, np.zeros(k + 4))
    model = Model(mean, scale, w[:k], w[k:].reshape(2, 2), 1.0, 0.0, float(label.mean()))
    share = model.shares(rows, chars, x, len(label))

    def curve(p):
        r = 1 / (1 + np.exp(-np.clip(p[0] * share + p[1], -30, 30))) - label
        return np.array([(r * share).mean(), r.mean()]) + SHRINK * p * np.array([1.0, 0.0])

    model.slope, model.shift = _adam(curve, np.array([1.0, 0.0]), 600, 0.05)
    return model


def _features(batches):
    schema = pa.schema([("doc", pa.int64()), ("quality", pa.int32()), ("chars", pa.float64()), ("x", pa.binary())])
    for batch in batches:
        ids, quality = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for lo, _, data, off in A.chunks(batch.column(1)):
            rows, chars, x = line_features(data, off)
            yield to_batch(schema, ids[lo + rows], quality[lo + rows], chars, [r.tobytes() for r in x])


def held_out(doc_id) -> DataFrame:
    """Whether crc32 of the id as text leaves no remainder by ``FOLDS``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``train_docs`` labelled documents outside the held-out fold.

    A document with several labels takes the least; null labels and ids aren't used.  Without any
    usable line the model gives the share of label 1, or 0.5, to every text.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = chosen.where("doc_id is not null and quality is not null").where(~held_out("doc_id"))
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = text.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")  # train_docs rows at most
    t = sample.mapInArrow(_features, "doc long, quality int, chars double, x binary").toArrow()
    doc, quality = t.column("doc").to_numpy(), t.column("quality").to_numpy()
    if not len(doc):
        return Model(np.zeros(1), np.ones(1), np.zeros(1), np.zeros((2, 2)), 0.0, 0.0, 0.5)
    x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(len(doc), -1)
    order = np.argsort(doc, kind="stable")
    _, first, rows = np.unique(doc[order], return_index=True, return_inverse=True)
    return train(rows.ravel(), t.column("chars").to_numpy()[order], x[order], (quality[order][first] == 1).astype(np.float64))


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _score(model: Model, batches):
    for batch in batches:
        for lo, hi, data, off in A.chunks(batch.column(1)):
            n = hi - lo
            if len(model.weights) > 1:
                rows, chars, x = line_features(data, off)
                score = model.score(model.shares(rows, chars, x, n))
            else:
                score = np.full(n, model.prior)
            ids = batch.column(0).slice(lo, n)
            out = [i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids.to_pylist()]
            yield to_batch(SCORED, ids, out, score, (score >= THRESHOLD).astype(np.int32))


def score_quality(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text, ...).

    Only the text enters a score.  Null, empty and wordless texts get the score of the training
    share of label 1.  Repeated rows score alike; a null doc_id is in no fold; other columns aren't
    read.
    """
    model = fit(docs, labels, train_docs)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(partial(_score, model), "doc_id long, held_out boolean, score double, predicted int")
