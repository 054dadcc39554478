"""Quality classifier: random-indexing word vectors and a small calibrated network.

A token is a run of letters, of digits, or of other signs. Random indexing gives
every token a fixed sparse ternary vector drawn from its hash; a token's word
vector is the sum of the index vectors found around it in the fitting texts.
Tokens outside the vocabulary share the vector of their shape: kind, length
class, and whether the same token came one or two places before. A document is
the mean of its tokens' vectors. Two numpy layers and a temperature, set on
texts the layers were not fitted on, turn that into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .textvec import U, as_bytes, mix, run_spans, span_hashes

DIM, SIGNS, WINDOW, HIDDEN = 96, 6, 2, 16
VOCABULARY = 4000
#: Labelled rows of each class the model is fitted on, and the longest used.
FIT_ROWS, FIT_CHARS = 1000, 60_000
FOLDS, HELD, THRESHOLD = 5, 0, 0.3
SHAPES = 4 * 8 * 3

_KIND = np.full(256, 3, dtype=np.int8)  # signs
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and shape of each token of the whole text."""
    buf = as_bytes(text)
    kinds = _KIND[buf]
    starts, ends = run_spans(kinds)
    h = span_hashes(buf, starts, ends)
    seen = np.zeros(len(h), dtype=np.int64)
    seen[2:][h[2:] == h[:-2]] = 2
    seen[1:][h[1:] == h[:-1]] = 1
    size = np.minimum(np.log2(np.maximum(ends - starts, 1)).astype(np.int64), 7)
    return h, (kinds[starts].astype(np.int64) * 8 + size) * 3 + seen


def index_vectors(h: np.ndarray) -> np.ndarray:
    """The fixed ternary vectors of tokens: ``SIGNS`` places each, half of them negative."""
    out = np.zeros((len(h), DIM), dtype=np.float32)
    rows = np.arange(len(h))
    for k in range(SIGNS):
        np.add.at(out, (rows, (mix(h + U(k + 1)) % U(DIM)).astype(np.int64)), 1.0 if k % 2 else -1.0)
    return out


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes
    vectors: np.ndarray  # of the vocabulary, then of the shapes
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float
    prior: float

    def ids(self, text: str | None) -> np.ndarray:
        h, shape = tokens(text)
        if not len(self.vocabulary):
            return shape
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        # a repeat counts as such whatever the token
        known = (self.vocabulary[at] == h) & (shape % 3 == 0)
        return np.where(known, at, len(self.vocabulary) + shape)

    def pooled(self, text: str | None) -> np.ndarray:
        ids = self.ids(text)
        if not len(ids):
            return np.zeros(self.vectors.shape[1], dtype=np.float32)
        n = np.bincount(ids)
        at = np.flatnonzero(n)
        return (n[at] @ self.vectors[at]) / len(ids)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), self.prior)
        x = np.stack([self.pooled(t) for t in texts]) if texts else np.zeros((0, self.vectors.shape[1]))
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def word_vectors(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, and vectors of them and of the shapes, from the tokens around each place."""
    every = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, U)
    names, counts = np.unique(every, return_counts=True)
    top = np.argsort(-counts, kind="stable")[:VOCABULARY]
    top = top[counts[top] >= 5]
    vocabulary = np.sort(names[top])
    total = len(vocabulary) + SHAPES
    context = np.zeros((total, DIM), dtype=np.float32)
    own = np.concatenate([index_vectors(vocabulary), index_vectors(mix(np.arange(SHAPES, dtype=U) + U(7)))])
    for h, shape in parts:
        if not len(h):
            continue
        at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
        known = (vocabulary[at] == h) & (shape % 3 == 0) if len(vocabulary) else np.zeros(len(h), bool)
        ids = np.where(known, at, len(vocabulary) + shape)
        for d in range(1, WINDOW + 1):
            np.add.at(context, ids[d:], own[ids[:-d]])
            np.add.at(context, ids[:-d], np.roll(own, 1, axis=1)[ids[d:]])
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    # the token's own index vector beside what stands around it
    return vocabulary, np.concatenate([context / np.maximum(norm, 1e-6), own / np.sqrt(SIGNS)], axis=1)


def train(rows: list[tuple[int, str, int]], totals: dict[int, int], seed: int = 7) -> Model:
    """Fit on labelled texts; ``totals`` gives each class its true weight."""
    n_all = sum(totals.values())
    prior = totals.get(1, 0) / n_all if n_all else 0.5
    empty = np.zeros(0)
    y = np.array([r[2] for r in rows], dtype=float)
    if len(rows) < 4 or y.min() == y.max():
        return Model(np.zeros(0, U), np.zeros((SHAPES, 2 * DIM), np.float32), empty, empty, (), 1.0, prior)
    vocabulary, vectors = word_vectors([tokens(r[1]) for r in rows])
    model = Model(vocabulary, vectors, empty, empty, (), 1.0, prior)
    x = np.stack([model.pooled(r[1]) for r in rows]).astype(float)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    cut = max(1, len(rows) // 5)
    held, fit = order[:cut], order[cut:]
    weight = np.array([totals[int(k)] / max(1, (y == k).sum()) for k in y])
    weight /= weight.mean()
    model.mean, model.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    z = (x - model.mean) / model.scale
    p = [rng.normal(0, 0.1, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, 401):
        pick = rng.choice(fit, size=min(256, len(fit)), replace=False)
        hid = np.tanh(z[pick] @ p[0] + p[1])
        out = 1 / (1 + np.exp(-np.clip(hid @ p[2] + p[3], -40, 40)))
        d = weight[pick] * (out - y[pick]) / len(pick)
        dh = np.outer(d, p[2]) * (1 - hid**2)
        grads = [z[pick].T @ dh + 1e-3 * p[0], dh.sum(0), hid.T @ d + 1e-3 * p[2], d.sum()]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    model.layers = tuple(p)
    raw = model.logits(x[held])

    def loss(temp: float) -> float:
        s = np.clip(raw / temp, -40, 40)
        return float((weight[held] * (np.logaddexp(0, s) - y[held] * s)).mean())

    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD) -> Model:
    rows, totals = common.labelled_sample(docs, labels, "quality", folds, held, FIT_ROWS, FIT_CHARS)
    return train(rows, totals)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from ``threshold`` on) of column ``text`` to every row.

    Null and empty texts are the zero vector, scored like any other. Labels of
    one class only, or too few, give every row their share. Repeated rows get
    equal scores; columns named like the two that are added are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = sent.value

        def each(batch: list) -> list[pa.Array]:
            s = own.scores(batch)
            return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]

        return each

    return common.map_text(docs, start, {"score": "double", "predicted": "int"}, keep, text)
