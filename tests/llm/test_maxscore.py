"""Exact top-k search against all inner products."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.llm import maxscore as X

from .conftest import clash

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0)
                                  for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(vectors, ids=None, k=10, every=5):
    ids = list(range(len(vectors))) if ids is None else ids
    ints = [None if v is None or any(c is None or not np.isfinite(c) for c in v)
            else np.floor(np.array(v, np.float32).astype(np.float64) * 1024).astype(np.int64) for v in vectors]
    out = []
    for i, q in enumerate(ints):
        if q is None or ids[i] is None or ids[i] % every:
            continue
        scored = sorted((-int(q @ x), ids[j] is None, ids[j] or 0, j) for j, x in enumerate(ints)
                        if j != i and x is not None and len(x) == len(q))
        out += [(ids[i], r + 1, None if none else vec, -s) for r, (s, none, vec, _) in enumerate(scored[:k])]
    return sorted(map(str, out))


def ours(df, k=10):
    return sorted(str(tuple(r)) for r in X.top_k(df, F.col("vec_id") % 5 == 0, k).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("kind", ["dense", "sparse", "clustered", "negative", "zero"])
def test_against_all_products(spark, kind, monkeypatch):
    monkeypatch.setattr(X, "SHARD", 40)
    monkeypatch.setattr(X, "QUERIES", 7)
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(300, 12)).astype(np.float32)
    if kind == "sparse":
        x[rng.random(x.shape) < 0.8] = 0
    if kind == "clustered":
        x = (x[rng.integers(0, 6, 300)] + rng.normal(size=x.shape) * 0.01).astype(np.float32)
    if kind == "negative":  # every score is negative
        x = np.abs(x) * np.where(np.arange(300) % 5 == 0, -1, 1)[:, None].astype(np.float32)
    if kind == "zero":
        x[::3] = 0
    assert ours(frame(spark, x)) == brute(x)


def test_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(X, "SHARD", 25)
    rng = np.random.default_rng(9)
    x = rng.integers(-1, 2, size=(200, 5)).astype(np.float32)
    x[60:130] = x[2]
    assert ours(frame(spark, x).repartition(9)) == brute(x)


def test_few_rows(spark):
    x = np.eye(4, dtype=np.float32)
    assert ours(frame(spark, x)) == brute(x)
    assert ours(frame(spark, x[:1])) == []
    assert ours(frame(spark, [])) == []


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = [list(v) for v in rng.normal(size=(30, 4)).astype(np.float32)]
    x += [None, [], [], [None, 1, 1, 1], [float("nan")] * 4, [float("-inf"), 0, 0, 0], [0.5, 0.25], [1, 1]]
    ids = list(range(len(x)))
    ids[3] = None
    ids[7] = 5       # a repeated id: rows of their own
    ids[31], ids[36] = 50, 55
    df = clash(frame(spark, x, ids), "x", "row", "shard", "rank", "a.b")
    assert ours(df) == brute(x, ids)


def test_too_large_scores_raise(spark):
    with pytest.raises(Exception, match="beyond a long"):
        ours(frame(spark, [[1e9, 1e9]] * 3))


def test_non_essential_terms_and_whole_shards_are_passed_over():
    rng = np.random.default_rng(4)
    x = np.abs(rng.integers(0, 5, size=(500, 8)))
    x[:, 0] = 0
    x[3] = [900, 0, 0, 0, 0, 0, 0, 0]
    shard = X.Shard.build(np.arange(500), np.arange(500), x)
    traversed = []
    own = shard.postings
    shard.postings = lambda term: traversed.append(term) or own(term)
    q = np.array([50, 1, 1, 1, 1, 1, 1, 1])
    docs, score = X.competitive(shard, q, 45000)
    assert docs.tolist() == [3] and score.tolist() == [45000]
    docs, score = X.competitive(shard, q, 45000 + 7 * 4 + 1)
    assert len(docs) == 0 and traversed.count(0) == 1


def test_query_and_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    cur = con.execute(X.ORACLE)
    cols = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    got = X.op12(spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(str(tuple(r)) for r in got.select(cols).collect()) == want
