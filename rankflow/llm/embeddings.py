"""Embedding near-duplicates by lattice hashing.

In each of ``TABLES`` tables a vector's direction is projected at random to
two blocks of eight numbers, each decoded to the nearest point of the E8
lattice; the two points name its cell.  A vector is stored in its own cell
and probes the two cells where one block takes the neighbouring lattice
point that is nearest to it.  Vectors that meet in a cell are compared by
cosine in double precision, so no link below the threshold is reported.

Vectors with the same numbers are one node that counts as often as it
occurs.  A cell is cut into blocks of bounded size and pairs of blocks are
compared as matrices, so hot cells spread over many tasks.  Every vector
carries its cells of all tables: a pair counts in the first table where it
meets only, so links are summed per vector without listing pairs, and a
block pair gives a spanning forest of its links for the components.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
numbers link with nothing; vectors of different lengths never link; rows
with a repeated or null vec_id are vectors of their own (a null is never the
smallest id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved, table
from .simhash import _forest

TABLES = 10
BLOCKS = 2  # lattice points per cell
CELLS = 1 + BLOCKS  # a vector's own cell of a table and those it probes
SCALE = 1.25
BLOCK = 512
SEED = 11


# ------------------------------------------------------------------ lattice

def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.round(x)
    off = x - near
    odd = near.sum(axis=1).astype(np.int64) % 2 == 1
    rows, worst = np.arange(len(x)), np.abs(off).argmax(axis=1)
    near[rows[odd], worst[odd]] += np.where(off[rows, worst] >= 0, 1, -1)[odd]
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of the even integers and of their half shift."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def next_point(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of the 240 neighbours of the points p, the nearest to x."""
    return p + ROOTS[((x - p) @ ROOTS.T).argmax(axis=1)]


def _key(points: list[np.ndarray]) -> np.ndarray:
    """32-bit names of cells; equal cells have equal names."""
    h = np.full(len(points[0]), 14695981039346656037, dtype=np.uint64)
    for p in points:
        for c in (np.round(p * 2).astype(np.int64) + 4096).astype(np.uint64).T:
            h = (h ^ c) * np.uint64(1099511628211)
    return (h ^ (h >> np.uint64(32))).astype(np.uint32)


def cells(unit: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Own cells (n, tables) and probed cells (n, tables, BLOCKS)."""
    n, dim = unit.shape
    rng = np.random.default_rng(SEED + dim)
    own, probes = np.empty((n, tables), np.uint32), np.empty((n, tables, BLOCKS), np.uint32)
    for t in range(tables):
        x = [unit @ rng.normal(size=(dim, 8)) * (SCALE / np.sqrt(8)) for _ in range(BLOCKS)]
        p = [decode(v) for v in x]
        own[:, t] = _key(p)
        for b in range(BLOCKS):
            probes[:, t, b] = _key([next_point(x[b], p[b]) if i == b else p[i] for i in range(BLOCKS)])
    return own, probes


# -------------------------------------------------------------- comparisons

def _layout(dim: int, tables: int, wide: bool) -> np.dtype:
    """One vector as a record: node, copies, cells, probes, numbers."""
    return np.dtype([("node", "<i8"), ("m", "<i8"), ("own", "<u4", (tables,)), ("probe", "<u4", (tables, BLOCKS)),
                     ("x", "<f8" if wide else "<f4", (dim,))])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _first_meeting(a: np.ndarray, b: np.ndarray, t: int, probing: bool) -> np.ndarray:
    """Which pairs of records did not meet before this table, and count here."""
    own = a["own"][:, :t] == b["own"][:, :t]
    met = own.any(axis=1)
    for k in range(BLOCKS):
        met |= (a["probe"][:, :t, k] == b["own"][:, :t]).any(axis=1)
        met |= (b["probe"][:, :t, k] == a["own"][:, :t]).any(axis=1)
    if probing:  # a probes b's cell; if b probes a's as well, the smaller node counts
        mutual = (b["probe"][:, t] == a["own"][:, t, None]).any(axis=1)
        met |= (mutual & (a["node"] > b["node"])) | (a["own"][:, t] == b["own"][:, t])
    return ~met


def compare(a: np.ndarray, b: np.ndarray, t: int, probing: bool, same: bool, least: float):
    """(nodes, links, roots) of the links of two blocks of records."""
    near = _unit(a["x"]) @ _unit(b["x"]).T >= least
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if len(i):
        first = (a["node"][i] != b["node"][j]) & _first_meeting(a[i], b[j], t, probing)
        i, j = i[first], j[first]
    if not len(i):
        return None
    nodes, at = np.unique(np.concatenate([a["node"][i], b["node"][j]]), return_inverse=True)
    p, q = at[:len(i)], at[len(i):]
    links = np.bincount(p, b["m"][j], len(nodes)) + np.bincount(q, a["m"][i], len(nodes))
    return nodes, links.astype(np.int64), nodes[_forest(len(nodes), p, q)]


# ------------------------------------------------------------------ operator

def _records(nodes: DataFrame, tables: int, wide: bool) -> DataFrame:
    """(dim, node, rec, cells): every vector once as a record, with its own
    cell and its probed cells of each table in turn."""
    def run(batches):
        for batch in batches:
            node, m = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            dims = batch.column(2).to_numpy()
            flat = batch.column(3).flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                rows = np.nonzero(dims == dim)[0]
                n = len(rows)
                x = flat[starts[rows][:, None] + np.arange(dim)]
                own, probes = cells(_unit(x), tables)
                rec = np.empty(n, dtype=_layout(int(dim), tables, wide))
                rec["node"], rec["m"], rec["own"], rec["probe"], rec["x"] = node[rows], m[rows], own, probes, x
                named = np.concatenate([own[:, :, None], probes], axis=2).astype(np.int64)
                ends = np.arange(n + 1, dtype=np.int32) * (tables * CELLS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, dim, np.int32)), pa.array(node[rows]),
                     pa.array([r.tobytes() for r in rec], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(named.ravel()))],
                    ["dim", "node", "rec", "cells"])
    return nodes.mapInArrow(run, "dim int, node long, rec binary, cells array<long>")


def links(nodes: DataFrame, least: float, tables: int, wide: bool) -> DataFrame:
    """(node, links, root) rows: linked vectors found in a pair of blocks,
    and the smallest node that the block pair's links reach.

    The cells move by number first; a vector moves only to the cells that
    another one shares.  A cell of one block is compared in one row; those of
    more blocks are cut, and pairs of blocks are compared."""
    recs = saved(_records(nodes, tables, wide))
    where = ["dim", "t", "cell"]
    places = recs.select("dim", "node", F.posexplode("cells").alias("at", "cell")).select(
        "dim", F.floor(F.col("at") / CELLS).cast("int").alias("t"), "cell",
        (F.col("at") % CELLS > 0).alias("probing"), "node")
    used = places.groupBy(*where).agg(F.count(F.lit(1)).alias("n"),
                                      F.count(F.when(~F.col("probing"), 1)).alias("stored"))
    # a cell that nobody shares has nothing to compare
    used = used.filter("n > 1 and stored > 0").select(*where, F.ceil(F.col("n") / BLOCK).alias("nb"))
    shared = saved(places.join(used, where))
    rec = recs.select("node", "rec")

    one = (shared.filter("nb = 1").join(rec, "node").groupBy(*where)
           .agg(F.collect_list(F.when(~F.col("probing"), F.col("rec"))).alias("b"),
                F.collect_list(F.when(F.col("probing"), F.col("rec"))).alias("p")))
    sides = F.array(F.struct(F.lit(False).alias("probing"), F.lit(True).alias("same"), F.col("b").alias("a")),
                    F.struct(F.lit(True).alias("probing"), F.lit(False).alias("same"), F.col("p").alias("a")))
    one = one.select("dim", "t", F.explode(sides).alias("s"), "b").filter("size(s.a) > 0").select(
        "dim", "t", "s.probing", "s.same", "s.a", "b")

    blocks = (shared.filter("nb > 1").join(rec, "node")
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")))
              .groupBy(*where, "probing", "block").agg(F.collect_list("rec").alias("recs")))
    blocks = saved(blocks)
    left = blocks.select(*where, "probing", F.col("block").alias("i"), F.col("recs").alias("a"))
    right = blocks.filter("not probing").select(*where, F.col("block").alias("j"), F.col("recs").alias("b"))
    cut = left.join(right, where).filter("probing or i <= j").select(
        "dim", "t", "probing", (~F.col("probing") & (F.col("i") == F.col("j"))).alias("same"), "a", "b")

    def run(batches):
        for batch in batches:
            found = []
            for dim, t, probing, same, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = _layout(dim, tables, wide)
                got = compare(np.frombuffer(b"".join(a), kind), np.frombuffer(b"".join(b), kind), t, probing, same, least)
                if got:
                    found.append(got)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)],
                                                 ["node", "links", "root"])
    return one.unionByName(cut).mapInArrow(run, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, tables: int = TABLES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    wide = "double" in vectors.schema["embedding"].dataType.simpleString()
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", e, F.when(F.coalesce(fine, F.lit(False)), F.xxhash64(e)).alias("node"))
    nodes = saved(rows.filter("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("low"), F.any_value("embedding").alias("embedding")))
    found = saved(links(nodes.select("node", "m", F.size("embedding").alias("dim"), "embedding"), least, tables, wide))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(nodes.select("node"), found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    comp = saved(comp.join(nodes.select("node", "m", "low"), "node"))
    low = comp.groupBy("component").agg(F.min("low").alias("component_id"))
    stats = comp.join(low, "component").join(degree, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(stats, "node", "left")
    cid = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      cid.alias("component_id"), F.col("vec_id").eqNullSafe(cid).alias("kept"))


def op7(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
