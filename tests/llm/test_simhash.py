"""SimHash groups against a brute-force version in plain Python."""

import itertools
import random
import re

import pytest
import xxhash

from rankflow.llm import simhash as S

from .conftest import clash


def slow_print(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(prints, radius):
    """Smallest id reachable; prints is a list of (id, fingerprint)."""
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
            parent[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return [low.get(top(i)) for i in range(len(prints))]


def as_rows(df):
    return sorted(((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in df.collect()), key=str)


def test_query_matches_brute_force(spark, sf, sf_docs):
    want = [(d, slow_print(t, 3)) for d, t in sf_docs]
    comp = slow_groups(want, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op4(spark, sf).collect()}
    assert got == {d: (f"{p:016x}", c) for (d, p), c in zip(want, comp, strict=True)}


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_links_of_planted_bits(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, 2 ** 64 - 1]
    near = [p ^ sum(1 << b for b in rng.sample(range(64), n)) for p in base for n in (1, 2, 3, 4)]
    prints = sorted(set(base + near))
    signed = [p - 2 ** 64 if p >= 2 ** 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "node long")
    links = S.link_fingerprints(nodes.withColumnRenamed("node", "fp"), radius)
    got = {r.node % 2 ** 64: r.component for r in S.components(nodes, links).collect()}
    ids = slow_groups(list(enumerate(prints)), radius)
    groups = {}
    for p, c in zip(prints, ids, strict=True):
        groups.setdefault(c, set()).add(got[p])
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_tiles_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    prints = [(i, 0b1011 << s | 1 << 50) for i, s in enumerate(range(0, 40))]
    nodes = spark.createDataFrame([(p,) for _, p in prints], "node long")
    got = S.components(nodes, S.link_fingerprints(nodes.withColumnRenamed("node", "fp"), 4)).collect()
    want = slow_groups(prints, 4)
    assert len({r.component for r in got}) == len(set(want))


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = [(d, slow_print(t, 3)) for d, t in rows]
    comp = slow_groups(want, 2)
    got = as_rows(S.near_duplicates(clash(odd, "fp", "node", "low", "component_id", "t"), 3, 2))
    assert got == sorted(((d, p, c) for (d, p), c in zip(want, comp, strict=True)), key=str)


def test_keep_one(spark, odd, no_docs):
    wide = clash(odd, "fp", "n", "win", "w", "id", "component_id")
    kept = S.keep_one(wide)
    assert kept.columns == wide.columns
    got = sorted(r.doc_id for r in kept.collect())
    groups = S.near_duplicates(odd)
    assert got == sorted(r[0] for r in groups.select("component_id").distinct().collect())
    assert S.keep_one(no_docs).count() == 0
    assert S.near_duplicates(no_docs).count() == 0


def test_only_null_ids_keep_one_row(spark, odd):
    rows = spark.createDataFrame([(None, "x y z", None, None, 1)] * 3, odd.schema)
    assert S.keep_one(rows).count() == 1
