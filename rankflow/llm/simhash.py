r"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprint: A-Z lower-cased, words ``[^\x20\x09-\x0D]+``, shingles of
``k`` words joined by a space (fewer words: the whole sequence), XXH64 with
seed 42 of each, repeats included; a bit is set if it is set in over half
of the hashes.  A text without words has fingerprint zero.

Linking: different fingerprints are put into tiles by the population counts
of their four 16-bit quarters.  Two fingerprints within ``radius`` bits have
counts that differ by ``radius`` in sum at most, so only such tile pairs
meet; all others are skipped.  Tiles are cut into blocks of bounded size,
and a pair of blocks is compared exactly with numpy (exclusive-or and bit
count).  A block pair gives a spanning forest of its links, not all pairs.

Equal fingerprints are one node, so a group of exact copies costs one row
per task.  Nothing is gathered on the driver but two counts.

Defined cases: null text counts as empty; a null doc_id takes part and is
never the smallest id (a group of null ids only has component null);
repeated rows are copies; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved, table

SEED = 42
QUARTERS = 4
BLOCK = 4096

# byte -> its eight bits as eight byte-wide counters in one word
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_RUN = 240  # rows summed before a byte-wide counter could overflow


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the uint64 hashes have each of the 64 bits set."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), _RUN * 256):  # bounded memory for very long texts
        part = h[at:at + _RUN * 256]
        full = np.zeros(-(-len(part) // _RUN) * _RUN, dtype="<u8")
        full[:len(part)] = part
        lanes = _LANES[full.view(np.uint8)].reshape(-1, _RUN, 8).sum(axis=1, dtype=np.uint64)
        total += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None, k: int) -> int:
    """Signed 64-bit fingerprint of one text."""
    words = (text or b"").lower().split()  # both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        spans = [joined]
    else:
        starts = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
        spans = [joined[a:b] for a, b in zip(starts[:-k].tolist(), (starts[k:] - 1).tolist(), strict=True)]
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in spans], dtype=np.uint64)
    bits = bit_counts(h) * 2 > len(h)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, fp) of every row."""
    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([fingerprint(t, k) for t in texts], pa.int64())], ["doc_id", "fp"])
    src = docs.select("doc_id", F.col("text").cast("binary").alias("t"))
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, fp long")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes under the links a-b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _compare(x: np.ndarray, y: np.ndarray, radius: int, rows: int = 512):
    """Index pairs of x and y within the radius."""
    out_a, out_b = [], []
    for at in range(0, len(x), rows):
        near = np.bitwise_count(x[at:at + rows, None] ^ y[None, :]) <= radius
        i, j = np.nonzero(near)
        out_a.append(i + at)
        out_b.append(j)
    return np.concatenate(out_a), np.concatenate(out_b)


def _near_tiles(radius: int) -> list[tuple[int, ...]]:
    """Half of the offsets of quarter counts that a pair within the radius can have."""
    steps = product(range(-radius, radius + 1), repeat=QUARTERS)
    return [d for d in steps if sum(map(abs, d)) <= radius and d >= (0,) * QUARTERS]


def link_fingerprints(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that connect the different fingerprints ``fp`` as all
    pairs within ``radius`` bits would."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(QUARTERS)]
    tiles = fps.select("fp", F.array(*quarter).alias("pc"))
    # at most 17 ** 4 tiles exist, whatever the input
    blocks_of = tiles.groupBy("pc").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("nb"))
    blocks = (tiles.join(F.broadcast(blocks_of), "pc")
              .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("nb")))
              .groupBy("pc", "block").agg(F.collect_list("fp").alias("fps")))
    blocks = saved(blocks)
    reach = F.array(*[F.array(*[F.col("pc")[q] + d[q] for q in range(QUARTERS)]) for d in _near_tiles(radius)])
    left = blocks.select(F.explode(reach).alias("tile"), F.col("pc").alias("from"),
                         F.col("block").alias("block_a"), F.col("fps").alias("x"))
    right = blocks.select(F.col("pc").alias("tile"), F.col("block").alias("block_b"), F.col("fps").alias("y"))
    pairs = (left.join(right, "tile")
             .filter((F.col("from") != F.col("tile")) | (F.col("block_a") <= F.col("block_b")))
             .select("x", "y"))

    def run(batches):
        for b in batches:
            xs, ys = b.column(0), b.column(1)
            out_a, out_b = [], []
            for i in range(b.num_rows):
                x, y = xs[i].values.to_numpy(), ys[i].values.to_numpy()
                p, q = _compare(x.view(np.uint64), y.view(np.uint64), radius)
                if len(p) == 0:
                    continue
                both, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                label = _forest(len(both), at[p], at[len(x) + q])
                own = np.nonzero(label != np.arange(len(both)))[0]
                out_a.append(both[own])
                out_b.append(both[label[own]])
            if out_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id
    reachable over links of ``radius`` bits or fewer."""
    prints = saved(fingerprints(docs, k))
    nodes = saved(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("low")))
    comp = components(nodes, link_fingerprints(nodes.select(F.col("node").alias("fp")), radius))
    comp = saved(comp.join(nodes, "node"))
    low = comp.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = comp.join(low, "component").select(F.col("node").alias("fp"), "component_id")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate group: the one with
    the smallest doc_id (of rows that share an id, the first by the hash of
    its text and its source, lang and n_chars; of rows with null ids one, and
    only where a group has no other id)."""
    groups = near_duplicates(docs, k, radius)
    wins = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    winners = (groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), wins.alias("win"))
               .filter("win").select(F.col("doc_id").alias("id"), "n"))
    rows = docs.alias("d").join(winners.alias("w"), F.expr("d.doc_id <=> w.id"))
    once = rows.filter("w.n = 1").select("d.*")
    # rows that share an id (or have none): a partial minimum before the shuffle
    again = (rows.filter("w.n > 1").select("d.*")
             .groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(
                 F.struct(*[F.col(f"`{c}`") for c in docs.columns]),
                 F.struct(F.xxhash64("text"), "source", "lang", "n_chars")).alias("__row"))
             .select("__row.*"))
    return once.unionByName(again)


def op4(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"), k=3, radius=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
