"""Whitening against numpy's eigenvectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.llm import whitening as W

from .conftest import clash

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else list(map(lambda c: None if c is None else float(c), v)), 0)
                                  for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def reference(vectors, k=16):
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1000000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    d = (n * fit - s) / n
    e, v = np.linalg.eigh(d.T @ d / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-10 * e[0]).sum()) if e[0] > 0 else 0)
    white = ((n * x - s) / n) @ v[:, :k] / np.sqrt(e[:k])
    return n, ((n * x - s) ** 2).sum(axis=1), white, e[:k] / max(e.sum(), 1e-300)


def check(df, vectors, k=16):
    n, dev, white, share = reference(vectors, k)
    got = df.toPandas().sort_values(["vec_id", "component"])
    assert len(got) == white.size
    if not len(got):
        return
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    mat = got.whitened.to_numpy().reshape(white.shape)
    sign = np.sign((mat * white).sum(axis=0))
    assert np.abs(mat * sign - white).max() < 1e-8
    assert (got.deviation.to_numpy().reshape(white.shape) == dev[:, None]).all()
    assert np.allclose(got.explained.to_numpy().reshape(white.shape), share, rtol=1e-9)


@pytest.mark.parametrize("n,dim", [(200, 24), (40, 8), (6, 12), (30, 1)])
def test_against_eigenvectors(spark, n, dim):
    rng = np.random.default_rng(n)
    x = (rng.normal(size=(n, dim)) * rng.uniform(0.2, 2, dim)).astype(np.float32)
    check(W.whiten(frame(spark, x)), x)


def test_copies_count_once(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 10)).astype(np.float32)
    x[20:] = x[3]
    check(W.whiten(frame(spark, x).repartition(7)), x)


def test_steep_spectrum_stops_early_and_misses_nothing():
    """Also with repeated singular values, which one start vector meets once."""
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(300, 40)))
    r, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    sigma = np.concatenate([[9, 9, 9, 5, 5], 1e-3 ** np.arange(1, 36)])
    x, steps = (q * sigma) @ r.T, []

    def product(a, basis):
        steps.append(1)
        p = x @ a
        return x.T @ p, (x @ basis).T @ p, float(p @ p)
    s, v = W.bidiagonalise(product, 40, float((x ** 2).sum()), 5)
    assert np.allclose(s[:5], sigma[:5], rtol=1e-10)
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-12
    assert np.allclose(np.linalg.norm(x @ v[:, :5], axis=0), sigma[:5])


def test_steps_are_fewer_than_dimensions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3)) @ rng.normal(size=(3, 60)) * 10 + rng.normal(size=(500, 60)) * 1e-3
    steps = []

    def product(a, basis):
        steps.append(1)
        p = x @ a
        return x.T @ p, (x @ basis).T @ p, float(p @ p)
    s, _ = W.bidiagonalise(product, 60, float((x ** 2).sum()), 3)
    assert np.allclose(s[:3], np.linalg.svd(x, compute_uv=False)[:3]) and len(steps) < 30


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    x = list(rng.normal(size=(20, 4)).astype(np.float32))
    odd = [None, [], [None, 1.0, 1.0, 1.0], [float("nan"), 0, 0, 0], [float("inf"), 0, 0, 0]]
    df = frame(spark, x + odd)
    got = W.whiten(clash(df, "x", "n", "component", "a.b"))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got, x)
    # a null id and a repeated one
    got = W.whiten(frame(spark, x, ids=[None, 1, 1, *range(3, 20)]))
    assert got.count() == 80 and got.filter("vec_id is null").count() == 4 and got.filter("vec_id = 1").count() == 8


def test_two_lengths_are_two_tables(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(20, 4)).astype(np.float32), rng.normal(size=(15, 3)).astype(np.float32)
    got = W.whiten(frame(spark, [*a, *b]))
    check(got.filter("vec_id < 20"), a)
    check(got.filter("vec_id >= 20").withColumn("vec_id", F.col("vec_id") - 20), b)


def test_no_variance(spark):
    assert W.whiten(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, [None, []])).count() == 0


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()
    check(W.op11(spark, sf), [r[0] for r in rows])
