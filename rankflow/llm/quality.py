"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams: of raw bytes (3), of the text's shape
(runs of capitals, other letters, digits, blanks, each other sign; 2 to 5)
and of a word that follows itself.  Every n-gram has two indicators, "there"
and "there often" (once in ``OFTEN`` bytes or more); the doubled word has one
per share of the words in ``REPEATS``.  Each indicator is
scaled by its class log-count ratio, and a linear hinge-loss model is fitted
by dual coordinate descent.  Margins become scores by a logistic fit on a
fifth of the sample that the model has not seen.

The fit uses at most ``per_class`` labelled texts of each class of up to
``max_bytes`` bytes; scoring reads every whole text.

Defined cases: null and empty texts have no features and get the score of
the intercept; a training sample without both classes gives 0.5 to all;
null ids and repeated rows are scored like others; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, table
from .labelled import fit_in_task, sample

BITS = 16
OFTEN = 48
REPEATS = (0.1, 0.2, 0.3, 0.5)
PER_CLASS = 4000
MAX_BYTES = 200_000
PART = 1 << 20

_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57
               else 32 if c in b" \t\n\r\v\f" else c for c in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _grams(b: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hashed ids of all n-grams (n up to 7) of a byte array."""
    if len(b) < n:
        return np.empty(0, dtype=np.int64)
    x = np.full(len(b) - n + 1, salt, dtype=np.uint64)
    for i in range(n):
        x = (x << np.uint64(8)) | b[i:len(b) - n + 1 + i]
    return ((x * _MULT) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: bytes | None) -> np.ndarray:
    """Sorted indicator ids of one text, below 2 ** (BITS + 1)."""
    text = text or b""
    counts = np.zeros(1 << BITS, dtype=np.int64)
    for at in range(0, len(text), PART):  # bounded memory for very long texts
        part = text[at:at + PART + 8]
        raw = np.frombuffer(part, dtype=np.uint8)
        shape = np.frombuffer(part.translate(_SHAPE), dtype=np.uint8)
        shape = shape[np.concatenate([[True], shape[1:] != shape[:-1]])] if len(shape) else shape
        ids = [_grams(raw, 3, 7), *(_grams(shape, n, n) for n in (2, 3, 4, 5))]
        counts += np.bincount(np.concatenate(ids), minlength=1 << BITS)
    words = text.split()
    again = sum(map(eq, words, words[1:]))
    levels = [i for i, share in enumerate(REPEATS) if again > share * len(words)]
    counts[:len(REPEATS)] = 0
    there = np.nonzero(counts)[0]
    often = there[counts[there] * OFTEN >= max(len(text), 1)]
    return np.concatenate([np.array(levels, dtype=np.int64), there, often + (1 << BITS)])


class Rows:
    """Indicator ids of many texts in one flat array, with the scaled values
    of each text brought to length 1."""

    def __init__(self, texts):
        parts, some, ends = [], [], [0]
        for t in texts:
            some.append(features(t).astype(np.int32))
            ends.append(ends[-1] + len(some[-1]))
            if len(some) == 256:
                parts.append(np.concatenate(some))
                some = []
        self.ids = np.concatenate([*parts, *some]) if ends[-1] else np.empty(0, np.int32)
        self.ends, self.values = ends, None

    def scale(self, by: np.ndarray) -> None:
        self.values = by[self.ids].astype(np.float32)
        for i in range(len(self)):
            v = self.values[self.ends[i]:self.ends[i + 1]]
            v /= np.sqrt(v @ v) or 1.0

    def __len__(self):
        return len(self.ends) - 1

    def __getitem__(self, i):
        at = slice(self.ends[i], self.ends[i + 1])
        return self.ids[at], None if self.values is None else self.values[at]


def _dual_descent(rows: Rows, use: np.ndarray, y: np.ndarray, size: int, c: float = 1.0,
                  epochs: int = 15) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent over the rows
    ``use``; the intercept is one more feature of value 1."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(use):
            r, v = rows[i]
            g = y[i] * (w[r] @ v + bias) - 1
            step = min(max(alpha[i] - g / 2.0, 0.0), c) - alpha[i]
            if step:
                alpha[i] += step
                w[r] += step * y[i] * v
                bias += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, bias


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(y = 1 | margin), with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    x = np.stack([m, np.ones_like(m)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        da, db = np.linalg.solve(h, x.T @ (p - t))
        a, b = a - np.clip(da, -5, 5), b - np.clip(db, -5, 5)
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


class Model:
    """Weights per indicator; ``score`` of a text is a probability."""

    def __init__(self, scale, w, bias, a, b):
        self.scale, self.w, self.bias, self.a, self.b = scale, w, bias, a, b

    def margin(self, ids: np.ndarray) -> float:
        v = self.scale[ids]
        return float(self.w[ids] @ v) / float(np.sqrt(v @ v) or 1.0) + self.bias

    @property
    def fitted(self) -> bool:
        return self.scale is not None

    def score(self, text: bytes | None) -> float:
        if self.scale is None:
            return 0.5
        z = self.a * self.margin(features(text)) + self.b
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(texts, labels: list[int]) -> Model:
    """The model of some texts (any iterable of bytes) and their labels."""
    y = np.where(np.array(labels, dtype=int) == 1, 1, -1)
    if not (y > 0).any() or not (y < 0).any():
        return Model(None, None, 0.0, 1.0, 0.0)
    rows, size = Rows(texts), 2 << BITS
    share = [np.ones(size), np.ones(size)]
    for i, s in enumerate(y):
        share[int(s > 0)][rows[i][0]] += 1
    scale = np.log((share[1] / share[1].sum()) / (share[0] / share[0].sum()))
    rows.scale(scale)
    late = np.arange(len(rows)) % 5 == 4
    if not ((y[late] > 0).any() and (y[late] < 0).any() and (y[~late] > 0).any() and (y[~late] < 0).any()):
        late = np.zeros(len(rows), dtype=bool)
    w, bias = _dual_descent(rows, np.nonzero(~late)[0], y, size)
    model = Model(scale, w, bias, 1.0, 0.0)
    use = np.nonzero(late if late.any() else ~late)[0]
    m = np.array([model.margin(rows[i][0]) for i in use])
    model.a, model.b = _logistic(m, y[use])
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2,
          per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    return fit_in_task(sample(docs, labels, "quality", folds, held, per_class, max_bytes), fit)


def score(model: Model, text: Column, spark) -> Column:
    """Probability of label 1 as a column over a text column."""
    shared = spark.sparkContext.broadcast(model)  # two arrays of 2 ** (BITS + 1) numbers

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return run(F.coalesce(text.cast("binary"), F.lit(b"")))


def keep(docs: DataFrame, labels: DataFrame, least: float = 0.7, **how) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``; all rows if
    there is no model, as no label says what to reject."""
    model = train(docs, labels, **how)
    if not model.fitted:
        return docs
    return docs.filter(score(model, F.col("text"), docs.sparkSession) >= least)


def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
                       score(model, F.col("text"), spark).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
