"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct buckets of its words, of the words' stems
(first bytes, so that an unseen ending doesn't hide a seen stem), of word pairs,
and of pairs that skip one word, in lower case. Each coordinate has its own rate, and the L1
term leaves few weights, which are sent to the executors as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .quality import _KIND
from .textvec import U, as_bytes, mix, run_spans, span_hashes

BITS = 20
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 6.0, 0.1, 8
#: Lengths of stems in UTF-8 bytes.
STEMS = (4, 5, 6)
#: Labelled rows of each class the model is fitted on, and the longest used.
FIT_ROWS, FIT_CHARS = 2500, 60_000
FOLDS, HELD, THRESHOLD = 3, 1, 0.7
_LETTERS = np.where(_KIND == 1, 1, 0).astype(np.int8)


def buckets(text: str | None) -> np.ndarray:
    """Bucket of each word, stem, pair and skip-pair of the whole text, in no order and with repeats."""
    buf = as_bytes((text or "").lower())
    starts, ends = run_spans(_LETTERS[buf])
    h = span_hashes(buf, starts, ends)
    pair = mix(h[:-1] * U(3) + mix(h[1:]) + U(11))
    skip = mix(h[:-2] * U(5) + mix(h[2:]) + U(13))
    stems = []
    for k in STEMS:
        long = ends - starts > k
        stems.append(mix(span_hashes(buf, starts[long], starts[long] + k) + U(k)))
    return (np.concatenate([h, pair, skip, *stems]) >> U(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    at: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.at] = self.weights
        return out


def train(rows: list[tuple[int, str, int]], totals: dict[int, int], seed: int = 5) -> Model:
    """One pass a row, ``EPOCHS`` times, in a fixed shuffled order; ``totals`` gives each class its true weight.

    A class is sampled whatever its texts are, so its share of the odds is put right in the bias.
    """
    n_all = sum(totals.values())
    share = (totals.get(1, 0) + 0.5) / (n_all + 1)
    base = float(np.log(share / (1 - share)))
    feats = [np.unique(buckets(r[1])) for r in rows]
    y = np.array([r[2] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), base)
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = 0.0, 1.0
    rng = np.random.default_rng(seed)

    def weight(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(feats)):
            at = feats[i]
            w = weight(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -40, 40))) - y[i]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
            bias_n += g * g
            bias -= 0.1 * g / np.sqrt(bias_n)
    bias += np.log(max(1, totals.get(1, 0)) / (y == 1).sum()) - np.log(max(1, totals.get(0, 0)) / (y == 0).sum())
    every = np.flatnonzero(np.abs(z) > L1)
    return Model(every, weight(every).astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD) -> Model:
    rows, totals = common.labelled_sample(docs, labels, "toxic", folds, held, FIT_ROWS, FIT_CHARS)
    return train(rows, totals)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from ``threshold`` on) of column ``text`` to every row.

    Null and empty texts have no feature: their score is that of the bias.
    Labels of one class only give every row their share. Repeated rows get equal
    scores; columns named like the two that are added are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        dense, bias = sent.value.dense(), sent.value.bias

        def one(text: str | None) -> float:
            at = buckets(text)
            at = np.unique(at[dense[at] != 0])
            return float(1 / (1 + np.exp(-np.clip(dense[at].sum() + bias, -40, 40))))

        def each(batch: list) -> list[pa.Array]:
            s = np.array([one(t) for t in batch], dtype=float)
            return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]

        return each

    return common.map_text(docs, start, {"score": "double", "predicted": "int"}, keep, text)
