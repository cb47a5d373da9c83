"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is lower-cased (A-Z) and cut into words of letters, digits and
non-ASCII bytes; every word with its two end marks gives byte n-grams of 3
to 6, hashed into ``2 ** BITS`` embedding rows, so unseen misspellings share
vectors with the words they come from.  A word right after itself counts
once.  The rows of ``BLOCK`` consecutive words are averaged and go through a
linear softmax; the text's probability
is that of its most toxic block, so the length of a text does not dilute a
passage.  Embeddings and softmax are trained jointly in numpy by ``UPDATES``
steps over the sample, reordered per pass with a fixed seed: of every text
its currently most toxic block gets the gradient.

The fit uses at most ``per_class`` labelled texts of each class of up to
``max_bytes`` bytes; scoring reads every whole text.

Defined cases: null and empty texts, and texts without words, have no block
and score as an average of zero (the intercept); a sample without both
classes gives 0.5 to all; null ids and repeated rows are scored like others;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, table
from .labelled import fit_in_task, sample

BITS = 17
DIM = 8
GRAMS = (3, 4, 5, 6)
BLOCK = 12
LEAST = 100  # a block of fewer n-grams is averaged as if of so many
REFRESH = 200  # texts between two refreshes of the odds that choose the blocks
UPDATES = 60_000
PER_CLASS = 4000
MAX_BYTES = 100_000
PART_WORDS = BLOCK * 4096

_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
_MULT = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.empty(0, dtype=np.int64)


def _ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the n-grams of some words, and where each block of
    ``BLOCK`` words starts among them."""
    b = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
    blank = b == 32
    seen = np.cumsum(blank)
    word = seen - 1  # the word that an n-gram starting here belongs to
    ids, own = [], []
    x = b.astype(np.uint64)
    for n in range(2, GRAMS[-1] + 1):
        if len(b) < n:
            break
        x = (x[:len(b) - n + 1] << np.uint64(8)) | b[n - 1:]
        if n < GRAMS[0]:
            continue
        # no blank strictly inside
        keep = np.nonzero(seen[n - 2:len(b) - 1] == seen[:len(b) - n + 1])[0]
        ids.append(((x[keep] * _MULT) >> np.uint64(64 - BITS)).astype(np.int32))
        own.append(word[keep])
    ids, own = np.concatenate(ids), np.concatenate(own) // BLOCK
    own = np.minimum(own, max(len(words) // BLOCK - 1, 0))  # a short rest joins the block before
    order = np.argsort(own, kind="stable")
    own = own[order]
    starts = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]))[0] if len(own) else _EMPTY
    return ids[order], starts


def blocks(text: bytes | None):
    """(ids, block starts) of a text, in parts of bounded size."""
    words = (text or b"").translate(_WORDS).split()
    words = [w for w, before in zip(words, [None, *words]) if w != before]
    for at in range(0, len(words), PART_WORDS):
        ids, starts = _ids(words[at:at + PART_WORDS])
        if len(ids):
            yield ids, starts, np.maximum(np.diff(np.append(starts, len(ids))), LEAST)


class Model:
    """``logit[i]`` is the softmax's log-odds of embedding row i."""

    def __init__(self, logit, bias, a=1.0, b=0.0):
        self.logit, self.bias, self.a, self.b = logit, bias, a, b

    def margin(self, text: bytes | None) -> float:
        best = None
        for ids, starts, sizes in blocks(text):
            mean = np.add.reduceat(self.logit[ids], starts) / sizes
            best = max(mean.max(), best) if best is not None else mean.max()
        return (0.0 if best is None else float(best)) + self.bias

    @property
    def fitted(self) -> bool:
        return self.logit is not None

    def score(self, text: bytes | None) -> float:
        if self.logit is None:
            return 0.5
        z = self.a * self.margin(text) + self.b
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(texts, labels: list[int], updates: int = UPDATES, rate: float = 0.4) -> Model:
    y = np.array(labels, dtype=int)
    if not (y == 1).any() or not (y == 0).any():
        return Model(None, 0.0)
    rng = np.random.default_rng(0)
    emb = np.zeros((1 << BITS, DIM))  # rows that no text has trained say nothing
    out = rng.uniform(-1, 1, (DIM, 2))
    bias = np.zeros(2)
    parts = [list(blocks(t)) for t in texts]
    done = 0
    while done < updates:
        for i in rng.permutation(len(parts))[:updates - done]:
            if done % REFRESH == 0:
                odds = emb @ (out[:, 1] - out[:, 0])
            lr = rate * (1 - done / updates)
            done += 1
            best, top, size = -np.inf, None, 1
            for ids, starts, sizes in parts[i]:
                mean = np.add.reduceat(odds[ids], starts) / sizes
                k = int(mean.argmax())
                if mean[k] > best:
                    best, size = mean[k], sizes[k]
                    top = ids[starts[k]:starts[k + 1] if k + 1 < len(starts) else None]
            if top is None:
                continue
            hidden = emb[top].sum(axis=0) / size
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1  # gradient of the loss at the softmax's input
            back = out @ p
            out -= lr * 0.1 * np.outer(hidden, p)
            bias -= lr * 0.1 * p
            np.subtract.at(emb, top, lr * back)
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0,
          per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    return fit_in_task(sample(docs, labels, "toxic", folds, held, per_class, max_bytes), fit)


def score(model: Model, text: Column, spark) -> Column:
    """Probability of toxicity as a column over a text column."""
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS numbers

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return run(F.coalesce(text.cast("binary"), F.lit(b"")))


def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
                       score(model, F.col("text"), spark).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
