"""Lattice hashing: decoding, recall against brute force, exact counts."""

import numpy as np
import pytest

from rankflow.llm import embeddings as E

from .conftest import clash


def slow(rows, least=0.9):
    """{row number: (links, component)} over all pairs."""
    ok = [i for i, (_, x) in enumerate(rows)
          if x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    out = {i: (0, rows[i][0]) for i in range(len(rows))}
    parent = {i: i for i in ok}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    deg = dict.fromkeys(ok, 0)
    for dim in {len(rows[i][1]) for i in ok}:
        own = [i for i in ok if len(rows[i][1]) == dim]
        u = np.array([rows[i][1] for i in own], dtype=np.float64)
        u /= np.linalg.norm(u, axis=1)[:, None]
        near = np.triu(u @ u.T >= least, 1)
        for p, q in zip(*np.nonzero(near), strict=True):
            deg[own[p]] += 1
            deg[own[q]] += 1
            parent[top(own[p])] = top(own[q])
    low = {}
    for i in ok:
        if rows[i][0] is not None:
            low[top(i)] = min(low.get(top(i), rows[i][0]), rows[i][0])
    for i in ok:
        out[i] = (deg[i], low.get(top(i)))
    return out


def test_decode_is_nearest():
    x = np.random.default_rng(1).normal(size=(300, 8)) * 2
    p = E.decode(x)
    d = ((x - p) ** 2).sum(axis=1)
    other = ((x[:, None] - (p[:, None] + E.ROOTS[None])) ** 2).sum(axis=2).min(axis=1)
    assert (d <= other + 1e-9).all() and (d <= 1 + 1e-9).all()
    q = E.next_point(x, p)
    assert np.allclose(((x - q) ** 2).sum(axis=1), other)
    whole, half = np.isclose(p % 1, 0).all(axis=1), np.isclose(p % 1, 0.5).all(axis=1)
    assert (whole | half).all() and np.isclose(p.sum(axis=1) % 2, 0).all()


def test_query_matches_brute_force(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = {rows[i][0]: v for i, v in slow(rows).items()}
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.op7(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("dim", [64, 192])
def test_recall_at_the_threshold(spark, dim):
    """Pairs of cosine 0.9 to 0.92 and no other links: at least 0.9 are found."""
    rng = np.random.default_rng(3)
    u = rng.normal(size=(1500, dim))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    c = rng.uniform(0.9001, 0.92, size=(len(u), 1))
    v = c * u + np.sqrt(1 - c * c) * w
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([u, v]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    found = sum(got[i + len(u)].component_id == i for i in range(len(u)))
    assert found / len(u) >= 0.9
    assert all(r.n_links <= 1 for r in got.values())


@pytest.mark.parametrize("block", [4, 512])
def test_groups_copies_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(5)
    one = rng.normal(size=16)
    rows = [(i, (one + rng.normal(size=16) * 0.02).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(20)]  # copies
    rows += [(130, (np.array(rows[4][1]) * 7).tolist()), (None, rows[4][1]), (4, rows[4][1])]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [None] * 16), (204, [float("nan")] * 16),
             (205, [float("inf")] + [0.0] * 15), (206, [1.0, 0.0]), (207, [2.0, 0.1]), (None, None), (208, (-one).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = slow(rows)
    got = E.near_duplicates(clash(df, "node", "m", "low", "label")).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=key) == sorted(
        [(rows[i][0], *v) for i, v in want.items()], key=key)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_move_to_shared_cells_only(spark, monkeypatch):
    """The rows that carry vectors to cells are those of cells with a second vector."""
    rng = np.random.default_rng(9)
    far = rng.normal(size=(300, 64))
    pair = far[:5] + rng.normal(size=(5, 64)) * 0.01
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([far, pair]))]
    kept = []
    real = E.saved
    monkeypatch.setattr(E, "saved", lambda df: kept.append(real(df)) or kept[-1])
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.vec_id for r in got.collect() if r.n_links} == {*range(5), *range(300, 305)}
    shared = next(df for df in kept if "nb" in df.columns)
    assert "rec" not in shared.columns and 10 <= shared.count() < len(rows) * E.TABLES * E.CELLS / 3


def test_no_rows(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
