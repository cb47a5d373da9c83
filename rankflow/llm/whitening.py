"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries c become integers x = floor(scale * c) + offset.  The fit list has
each different x vector once: n vectors with sums S per dimension.  Centred
rows are (n * x - S) / n, the numerator exact.

A step of the bidiagonalisation needs the product of the centred rows with a
right vector and the product of their transpose with the left vector that
comes of it.  A left vector is as long as the fit list, so it is not stored:
every left vector is a combination of the rows, and its entry is computed
again from its row.  One pass over the rows, summed by partition and then by
Spark, thus gives both products of a step and the inner products with all
earlier left vectors; with these the new left vector is reorthogonalised
(the pass is repeated where much of it goes), the right one on the driver
against all earlier ones, twice.  The driver holds dimension times steps
numbers, whatever the rows.  The singular values and right vectors of the
small bidiagonal matrix give components and deviations.

A vanishing left or right vector (fewer independent rows or directions than
dimensions) is followed by a new random direction.  The steps end when they
have used up the dimensions, or earlier when the wanted components have
converged and the variance not yet seen is less than the least of them, so
that nothing can have been missed (repeated variances included).

Defined cases: vectors that are null or hold null or non-finite entries give
no rows; rows with the same vec_id or a null one have rows of their own;
vectors of different length are different tables, each with its own fit; a
component without variance does not count (one vector, copies of it, empty
vectors: none), so there may be fewer than asked; components of the same
variance are any orthogonal ones; an empty table gives no rows; other
columns are ignored; deviations beyond a long raise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .maxscore import whole_vectors

SCALE = 64.0
OFFSET = 1_000_000
SEED = 7
EPS = np.finfo(np.float64).eps
#: Passes that a left vector is reorthogonalised in at most.
PASSES = 3
#: Bytes of the fit list that a task reads in a pass.
TASK_BYTES = 64 << 20


# ------------------------------------------------------- bidiagonalisation

def bidiagonalise(product: Callable, dim: int, total: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns), falling, of a
    matrix X of which only products are known.

    ``product(a, A)`` gives, with p = X a and U = X A, the vectors X'p and
    U'p and the number p'p.  ``total`` is the sum of squares of X.
    """
    rng = np.random.default_rng(SEED)
    tiny = EPS * dim * np.sqrt(total)
    right, left, back = (np.zeros((dim, 0)) for _ in range(3))  # V; A with U = XA; X'U
    alphas, betas = [], []
    if not tiny:
        return np.zeros(0), right

    def fresh():
        while True:
            z = _orthogonal(rng.normal(size=dim), right)
            if np.linalg.norm(z) > 0.1 / np.sqrt(dim):
                return z / np.linalg.norm(z)

    v = fresh()
    while True:
        right = np.column_stack([right, v])
        a = v - (betas[-1] * left[:, -1] if betas else 0.0)
        for _ in range(PASSES):  # the left vector against all before it
            w, c, pp = product(a, left)
            a, w, size = a - left @ c, w - back @ c, pp - c @ c
            if c @ c <= 1e-20 * pp or pp <= tiny ** 2:
                break
        else:
            size = 0.0  # nothing of its own is left
        alpha = np.sqrt(max(size, 0.0))
        if alpha <= tiny:
            alpha, a, w = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            a, w = a / alpha, w / alpha
        left, back = np.column_stack([left, a]), np.column_stack([back, w])
        alphas.append(alpha)
        z = _orthogonal(w - alpha * v, right)
        beta = float(np.linalg.norm(z))
        k = len(alphas)
        b = np.diag(alphas) + np.diag(betas, 1)
        p, s, qt = np.linalg.svd(b)
        if k == dim:
            break
        if beta <= tiny or alpha == 0.0:
            beta = 0.0
        unseen = total - s @ s
        if k >= wanted and (np.abs(p[-1, :wanted]) * beta).max() <= tiny and unseen < 0.999 * s[wanted - 1] ** 2:
            break
        v = z / beta if beta else fresh()
        betas.append(beta)
    return s, right @ qt.T


def _orthogonal(z: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        z = z - basis @ (basis.T @ z)
    return z


# ----------------------------------------------------------------- passes

def _packed(fit: DataFrame, dim: int) -> DataFrame:
    """(x): int64 matrices, as many rows each as come in a batch."""
    def pack(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["x"])
    return fit.mapInArrow(pack, "x binary")


def _summed(blocks: DataFrame, dim: int, part: Callable, kind: str, join: Callable = np.add,
            agg: Callable = F.sum) -> np.ndarray:
    """Sum (or other ``join``, ``agg``) of ``part(x)``, a flat vector, over
    all matrices x."""
    np_kind = {"long": np.int64, "double": np.float64}[kind]

    def run(batches):
        acc = None
        for b in batches:
            for x in b.column(0):
                got = part(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, dim))
                acc = got if acc is None else join(acc, got)
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc), dtype=np.int32)),
                                              pa.array(acc.astype(np_kind))], ["i", "v"])
    sums = blocks.mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(agg("v").alias("v")).collect()
    out = np.zeros(len(sums), np_kind)  # one number per entry of the vector
    for i, v in sums:
        out[i] = v
    return out


class Whitening:
    """The fit: ``n``, ``sums``, ``components`` as columns, ``variances``,
    ``explained`` shares and the measured ``identity_error``."""

    def __init__(self, fit: DataFrame, dim: int, wanted: int):
        self.dim = dim
        stored = saved(_packed(fit, dim))
        first = _summed(stored, dim, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), "long")
        self.n, self.sums = int(first[0]), first[1:]
        most = _summed(stored, dim, lambda x: np.array([np.abs(x).max()]), "long", np.maximum, F.max)
        if self.n * int(most[0]) >= 1 << 62:
            raise OverflowError("n times an entry is beyond a long")
        spark = fit.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, -(-self.n * dim * 8 // TASK_BYTES))
        blocks = stored.coalesce(tasks)
        n, sums = self.n, self.sums

        def centred(x):
            return (n * x - sums) / n

        def product(a, basis):
            def part(x):
                rows = centred(x)
                p = rows @ a
                return np.concatenate([rows.T @ p, (rows @ basis).T @ p, [p @ p]])
            got = _summed(blocks, dim, part, "double")
            return got[:dim], got[dim:-1], float(got[-1])

        total = float(_summed(blocks, dim, lambda x: np.array([(centred(x) ** 2).sum()]), "double")[0])
        sigma, vectors = bidiagonalise(product, dim, total, min(wanted, dim))
        use = np.nonzero(sigma[:wanted] > 1e-7 * sigma[:1].sum())[0]
        self.variances = sigma[use] ** 2 / n
        comps = vectors[:, use]
        sign = np.sign(comps[np.abs(comps).argmax(axis=0), np.arange(len(use))])
        self.components = comps * sign
        self.explained = sigma[use] ** 2 / total if total else np.zeros(0)
        self.identity_error = 0.0
        if len(use):
            scaled, k = self.components / np.sqrt(self.variances), len(use)

            def moments(x):
                z = centred(x) @ scaled
                return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])
            got = _summed(blocks, dim, moments, "double") / n
            cov = got[k:].reshape(k, k) - np.outer(got[:k], got[:k])
            self.identity_error = float(np.abs(cov - np.eye(k)).max())

    def apply(self, ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        """One row per vector and component."""
        k = len(self.variances)
        diff = self.n * x - self.sums
        top = int(np.abs(diff).max(initial=0))
        if self.dim * top ** 2 < 1 << 63:
            deviation = (diff * diff).sum(axis=1)
        else:
            deviation = np.array([sum(int(d) ** 2 for d in row) for row in diff], dtype=object)
            if max(deviation) >= 1 << 63:
                raise OverflowError("a deviation is beyond a long")
        white = (diff / self.n) @ self.components / np.sqrt(self.variances)
        rows = len(x) * k
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(np.repeat(np.arange(len(x)), k))),
             pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
             pa.array(np.full(rows, self.n)), pa.array(np.repeat(deviation.astype(np.int64), k)), pa.array(white.ravel()),
             pa.array(np.tile(self.explained, len(x))), pa.array(np.full(rows, self.identity_error))],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, components: int = 16, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error)
    of every usable row and component."""
    ints = F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(scale)) + F.lit(offset))
    rows = vectors.filter(whole_vectors(vectors)).select("vec_id", ints.alias("x"))
    kind = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}"
    schema = (f"{kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    out = None
    # one pass more for the lengths; embedding tables have one
    for (dim,) in rows.select(F.size("x").alias("dim")).filter("dim > 0").distinct().orderBy("dim").collect():
        own = rows.filter(F.size("x") == dim)
        fit = Whitening(own.select("x").distinct(), dim, components)

        def run(batches, fit=fit, dim=dim):
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
                if len(x) and len(fit.variances):
                    yield fit.apply(b.column(0), x)
        got = own.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else vectors.sparkSession.createDataFrame([], schema)


def op11(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"), 16)
