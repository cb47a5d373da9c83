"""Merkle manifest against a plain rebuild of the trees."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rankflow.llm import merkle as M

from .conftest import DOC, clash


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, lower=False):
    doc_id, text, lang, source, n = row
    if lower and text is not None:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return h(*map(field, (doc_id, source, lang, n, text)))


def climb(nodes):
    """(root, [(left, right) per level] of every node)."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(own):
            run = at // 8 * 8
            paths[k].append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + 8])))
            own[k] = at // 8
        nodes = [h(*nodes[k:k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    out, subs = [], []
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, paths = climb([leaf(r) for r in own])
        subs.append((lang, own, sub, paths))
    if not subs:
        return []
    root, tops = climb([s[2] for s in subs])
    for (_, own, sub, paths), top in zip(subs, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            lower = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, lower)
            for left, right in path + top:
                node = h(left, node, right)
            out.append((r[0], leaf(r), sub, root, h("".join(a + b for a, b in path + top)), node, node == root))
    return sorted(map(str, out))


def ours(df):
    tamper = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = M.manifest(M.leaves(df, tamper, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    return sorted(str(tuple(r)) for r in got.select(
        "doc_id", "leaf", "subroot", "root", proof, "folded_root", F.col("folded_root") == F.col("root")).collect())


def random_rows(n, langs, seed):
    rng = random.Random(seed)
    return [(k, rng.choice(["Some Text", "", None, "Ünï " * rng.randrange(5)]), rng.choice(langs),
             rng.choice(["a", None, "ß"]), rng.choice([None, k])) for k in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (8, ["en"]), (9, ["en"]), (700, ["en", "en", "en", None, "é"]),
                                     (60, [f"l{k}" for k in range(20)])])
def test_against_rebuild(spark, n, langs):
    rows = random_rows(n, langs, n)
    assert ours(spark.createDataFrame(rows, DOC)) == brute(rows)


def test_many_tiers_and_a_hot_lang(spark, monkeypatch):
    """Blocks of one digit: every level is a tier of its own."""
    monkeypatch.setattr(M, "DIGITS", 1)
    monkeypatch.setattr(M, "BLOCK", 8)
    rows = random_rows(300, ["en"] * 9 + ["de"], 3)
    assert ours(spark.createDataFrame(rows, DOC).repartition(5)) == brute(rows)


def test_odd_rows(odd, spark):
    rows = [tuple(r) for r in odd.collect()]
    rows += [(5, "one two", "en", "b", 7)] * 30  # full copies
    assert ours(clash(spark.createDataFrame(rows, DOC), "rank", "kids", "a.b", "total", "block")) == brute(rows)


def test_empty(no_docs):
    got = M.manifest(M.leaves(no_docs))
    assert got.count() == 0


def test_untouched_rows_verify(odd):
    got = M.manifest(M.leaves(odd))
    assert got.filter("folded_root <> root").count() == 0


def test_query_and_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cur = con.execute(M.ORACLE)
    cols = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    got = M.op13(spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(str(tuple(r)) for r in got.select(cols).collect()) == want
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256",
                                                    "folded_root", "verified").collect()) == brute(docs)
