r"""Language-model scoring by online logistic context mixing.

A text is lower-cased (A-Z) and cut into words ``[^\x20\x09-\x0D]+``; each
word is coded as its bytes and a closing blank, the end of the text as a
blank alone, so the code can be read back.  Every bit is predicted from
counts in hashed contexts: the last one, two, three and four bytes of the
word, and all of its bytes so far, each with the bits of the byte so far.
The predictions are stretched and mixed by weights that a gate selects (how
much the two longest contexts have seen, and the bit's place), and the
result is refined by an adaptive table over (bits so far, mixed
prediction).  A text's score is the log10 probability of its code.

Where the work runs: words are counted over all documents and dealt in
ranges of bounded size.  The context counts are a Spark aggregate over the
training counts of all words, by the context's 56-bit hash and the byte that
follows, as many as the corpus has; a range of words gets the counts of its
own contexts by a join, so nothing of them reaches the driver.  A beginning
of words stands in one range, which counts it itself, unless it is one of the
range's first or last word; only those and the short contexts are joined.  A
range works per different beginning, not per word that has it.  Weights and
refinement learn online in every range from all of its training words, each
by its count and predicted as if it had not been counted itself; their mean
over the ranges, by training tokens, is the model's.  Then the model is
frozen, so a score does not depend on the order of documents; every
different word is scored once, and documents look up the words of their
chunk, a run of rows with a bounded size of text.  (The table is read twice
in the same order for that; save a frame first whose order can change.)

``Model`` also works from counts in ``SLOTS`` hash slots (``events``), for a
few words in memory; ``score`` does not use them.

Defined cases: null texts count as empty (their end is scored); a null
doc_id is in the fold of the empty text; repeated rows are scored and
counted like others; without training rows every bit costs one bit; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, saved, table

ORDERS = (1, 2, 3, 4, 0)  # bytes of context; 0: the whole word so far
SLOT_BITS = (16, 18, 20, 20, 22)
RANGE_BYTES = 6_000_000  # coded words of a range
COUNT_FLUSH = 4_000_000
SUM_PARTS = 16  # rows of summed weights that the driver gets at most
STEP = 240  # words between two moves of the weights when a range learns
BLOCK_BYTES = 1 << 15  # of a block whose inputs are worked out at once
PER_SCORE = 2048  # beginnings that are scored at once
PER_STEP = 12  # bits whose errors a set of weights follows in full in one step
CHUNK_BYTES = 16_000_000
FLUSH = 400_000
PART_BYTES = 1 << 17
APM_STEPS = 33
_CLIP = 14.0

_OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])
SLOTS = int(_OFFSETS[-1])
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_POLY = 0xD6E8FEB86659FD93
_POLY_INVERSE = np.uint64(pow(_POLY, -1, 2 ** 64))


# ------------------------------------------------------------------ contexts

def contexts(words: list[bytes]):
    """(bytes, lengths, hashes per order) of some coded words."""
    b = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(b)) - starts
    x = b.astype(np.uint64)
    last = [np.where(place >= k, np.concatenate([np.zeros(k, np.uint64), x[:-k]]) if k < len(b) else 0, 256 + k)
            .astype(np.uint64) for k in (1, 2, 3, 4)]
    found, h = [], np.zeros(len(b), dtype=np.uint64)
    for k in range(4):
        h = (h + last[k] + np.uint64(1)) * _M2
        h ^= h >> np.uint64(29)
        found.append(h)
    # hash of the word so far: a polynomial in the place inside the word
    power, inverse = np.full(len(b), _POLY, np.uint64), np.full(len(b), _POLY_INVERSE, np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((x + np.uint64(1)) * power, out=total[1:])
    found.append((total[:-1] - total[starts]) * inverse[starts] + place.astype(np.uint64) * _M2)
    return b, lengths, found


def bits_of(b: np.ndarray):
    """(bits, so_far) of some bytes: so_far is the byte's bits before this
    one with a leading one."""
    shifts = np.arange(8)
    return (b[:, None] >> (7 - shifts)) & 1, (1 << shifts) | (b[:, None].astype(np.int64) >> (8 - shifts))


def codes_of(b: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """(bytes, orders): 56 bits of the context's hash and the byte behind it."""
    out = np.empty((len(b), len(ORDERS)), dtype=np.uint64)
    for o, h in enumerate(hashes):
        v = (h + np.uint64(o + 1)) * _M1
        v ^= v >> np.uint64(31)
        v *= _M2
        v ^= v >> np.uint64(29)
        out[:, o] = (v & ~np.uint64(255)) | b
    return out


def events(words: list[bytes]):
    """(slots, bits, so_far, owner) of all bits of some coded words: slots
    is (bits, orders), owner the index of the word."""
    b, lengths, hashes = contexts(words)
    bits, so_far = bits_of(b)
    slots = np.empty((len(b) * 8, len(ORDERS)), dtype=np.int32)
    for o, h in enumerate(hashes):
        v = (h[:, None] + so_far.astype(np.uint64) * _M2) * _M1
        v ^= v >> np.uint64(31)
        slots[:, o] = ((v * _M2) >> np.uint64(64 - SLOT_BITS[o])).astype(np.int32).ravel() + _OFFSETS[o]
    owner = np.repeat(np.repeat(np.arange(len(words)), lengths), 8)
    return slots, bits.ravel(), so_far.ravel(), owner


def parts(words: list[bytes]):
    """Runs of words of bounded size (a longer word is a run of its own)."""
    at, size = 0, 0
    for i, w in enumerate(words):
        if size and size + len(w) > PART_BYTES:
            yield at, i
            at, size = i, 0
        size += len(w) + 1
    if at < len(words):
        yield at, len(words)


class Beginnings:
    """The different beginnings of some coded words: their codes, the last
    order's being the beginning itself, and where each word's stand."""

    def __init__(self, words: list[bytes]):
        order = sorted(range(len(words)), key=words.__getitem__)
        words = [words[i] for i in order]
        codes, at, n = [np.zeros((0, len(ORDERS)), np.uint64)], [np.zeros(0, np.int32)], 0
        for lo, hi in parts(words):  # sorted, so few are in two parts; those are there twice
            b, _, hashes = contexts(words[lo:hi])
            every = codes_of(b, hashes)
            _, first, own = np.unique(every[:, -1], return_index=True, return_inverse=True)
            codes.append(every.take(first, axis=0))
            at.append((own + n).astype(np.int32))
            n += len(first)
        self.codes, self.at = np.concatenate(codes), np.concatenate(at)
        self.byte = (self.codes[:, -1] & np.uint64(255)).astype(np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.starts, self.lengths = np.empty((2, len(words)), dtype=np.int64)
        self.starts[order], self.lengths[order] = np.cumsum(lengths) - lengths, lengths

    def of(self, own: np.ndarray):
        """(beginnings, lengths) of some words, one after the other."""
        lengths = self.lengths[own]
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return self.at[np.repeat(self.starts[own], lengths) + place], lengths

    def sums(self, v: np.ndarray) -> np.ndarray:
        """Per word the sum of ``v`` over its beginnings."""
        order = np.argsort(self.starts)
        out = np.empty(len(order))
        if len(order):
            out[order] = np.add.reduceat(v[self.at], self.starts[order])
        return out

    def counts(self, c: np.ndarray) -> np.ndarray:
        """Per beginning the sum of the words' counts."""
        order = np.argsort(self.starts)
        return np.bincount(self.at, np.repeat(c[order], self.lengths[order]), len(self.codes))


def borders(words: list[bytes]) -> np.ndarray:
    """Contexts that words outside of a range may share: beginnings of its
    first and its last word."""
    if not words:
        return np.zeros(0, np.uint64)
    b, _, hashes = contexts([min(words), max(words)])
    return np.unique(codes_of(b, hashes)[:, -1] >> np.uint64(8))


class Paths:
    """Exact counts of the contexts of some words: per code (context and
    byte) how often the context was followed by the byte's first 0 to 8
    bits.  ``more``: codes that may lack a count.  ``n`` has a row of counts
    per code, but one for all codes of equal count that alone follow their
    context; ``row`` tells each code's."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, more: np.ndarray):
        every = np.concatenate([codes, more])
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])[:len(every)])
        self.codes = every[first]
        n = np.concatenate([n, np.zeros(len(more))])[order].astype(np.int64)
        del every, order
        n = np.add.reduceat(n, first) if len(first) else n
        ctx = self.codes >> np.uint64(8)
        new = np.concatenate([[True], ctx[1:] != ctx[:-1], [True]])[-len(ctx) - 1:]
        alone = new[:-1] & new[1:]
        several = self.codes[~alone]
        one, own = np.unique(n[alone], return_inverse=True)
        self.row = np.empty(len(n), dtype=np.int32)
        self.row[~alone], self.row[alone] = np.arange(len(several)), own + len(several)
        self.n = np.empty((len(several) + len(one), 9), dtype=np.int32 if n.sum() < 2 ** 31 else np.int64)
        self.n[len(several):] = one[:, None]
        n = n[~alone]
        for j in range(9):
            group = several >> np.uint64(8 - j)
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[:len(group)])
            if len(first):
                self.n[:len(several), j] = np.repeat(np.add.reduceat(n, first), np.diff(first, append=len(group)))

        self.place = np.zeros(len(self.n), dtype=np.int32)  # of a row in a block

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """(orders, beginnings): the rows of some codes."""
        return np.stack([self.row[np.searchsorted(self.codes, codes[:, o])] for o in range(len(ORDERS))])

    def of(self, words: list[bytes]):
        """(seen, same, bits, so_far, owner) of all bits: per order how often
        the context was seen, and with the bit that comes."""
        b, lengths, hashes = contexts(words)
        n = self.n[self.rows(codes_of(b, hashes)).T]
        bits, so_far = bits_of(b)
        owner = np.repeat(np.repeat(np.arange(len(words)), lengths), 8)
        seen, same = (n[:, :, k:k + 8].transpose(0, 2, 1).reshape(-1, len(ORDERS)) for k in (0, 1))
        return seen, same, bits.ravel(), so_far.ravel(), owner


# --------------------------------------------------------------------- model

def _stretch(p):
    return np.log(p / (1 - p))


def _squash(x):
    return 1 / (1 + np.exp(-x))


_BITS, _SO_FAR = bits_of(np.arange(256, dtype=np.uint8))


class Block:
    """Inputs of the model for a run of bytes, from the exact counts of their
    paths (``rows``: orders, bytes), worked out once per different row.
    ``less`` is taken off the counts of the bits that come."""

    def __init__(self, paths: Paths, rows: np.ndarray, less: int = 0):
        paths.place[rows] = 1
        used = np.flatnonzero(paths.place)
        paths.place[used] = np.arange(len(used))
        self.rows = paths.place.take(rows).astype(np.int64)
        paths.place[used] = 0
        n = np.ascontiguousarray(paths.n.take(used, axis=0).T).astype(np.float64)
        same, other = np.maximum(n[1:] - less, 0), n[:8] - n[1:]
        seen = same + other
        st = np.clip(np.log((same + 0.02) / (other + 0.02)), -_CLIP, _CLIP)
        self.st, self.sure = np.ascontiguousarray(st.T), np.ascontiguousarray((seen / (seen + 3)).T)
        level = np.ascontiguousarray(np.log2(seen + 1).T)
        self.long, self.longer = np.minimum(level / 2, 3).astype(np.uint8), np.minimum(level, 5).astype(np.uint8) * np.uint8(4)

    def inputs(self, at: slice, byte: np.ndarray):
        """(x, gate, bits, so_far) of all bits of some of the bytes."""
        rows, bits = self.rows[:, at], _BITS.take(byte, axis=0)
        x = np.empty((2, *rows.shape, 8))
        np.multiply(self.st.take(rows, axis=0), 2.0 * bits - 1, out=x[0])
        np.multiply(self.sure.take(rows, axis=0), x[0], out=x[1])
        gate = (self.longer.take(rows[4], axis=0) + self.long.take(rows[3], axis=0)).astype(np.int64) * 8 + np.arange(8)
        return x.reshape(2 * len(ORDERS), -1).T, gate.ravel(), bits.ravel(), _SO_FAR.take(byte, axis=0).ravel()


class Model:
    """Gated weights and the refinement table; counts per slot (n0, n1) for
    what is not counted in ``Paths``."""

    def __init__(self, counts: np.ndarray | None = None):
        self.counts = counts
        self.weights = np.full((8 * 6 * 4, 2 * len(ORDERS)), 0.15)
        grid = np.linspace(-8, 8, APM_STEPS)
        self.apm = np.tile(_squash(grid), (256, 1))

    def inputs(self, slots, less=None):
        """Stretched predictions, once plain and once by confidence, and the
        gate.  ``less``: a count per bit taken off the bit that came."""
        n = self.counts[slots].astype(np.float64)
        if less is not None:
            bits, take = less
            n[np.arange(len(bits)), :, bits] -= take[:, None]
            np.maximum(n, 0, out=n)
        return self.stretched(n.sum(axis=2), n[..., 1])

    @staticmethod
    def stretched(seen, ones):
        st = np.clip(_stretch((ones + 0.02) / (seen + 0.04)), -_CLIP, _CLIP)
        x = np.concatenate([st, st * (seen / (seen + 3))], axis=1)
        long, longer = seen[:, 3], seen[:, 4]
        gate = np.minimum(np.log2(longer + 1), 5).astype(np.int64) * 4 + np.minimum(np.log2(long + 1) / 2, 3).astype(np.int64)
        return x, gate

    def freeze(self) -> None:
        """Per slot what scoring needs, in place of the counts: stretched
        prediction, the same by confidence, and its part of the gate."""
        n = self.counts.sum(axis=1)
        p = (self.counts[:, 1] + np.float32(0.02)) / (n + np.float32(0.04))
        st = np.clip(_stretch(np.clip(p, 1e-7, 1 - 1e-7)), -_CLIP, _CLIP)
        self.tables = np.stack([st, st * (n / (n + 3))], axis=1).astype(np.float32)
        level = np.log2(n + 1)
        level = np.concatenate([np.minimum(level[:_OFFSETS[4]] / 2, 3), np.minimum(level[_OFFSETS[4]:], 5)])
        self.levels = level.astype(np.uint8)
        self.counts = None

    def frozen_inputs(self, slots):
        both = self.tables[slots]
        x = np.concatenate([both[..., 0], both[..., 1]], axis=1)
        return x, self.levels[slots[:, 4]].astype(np.int64) * 4 + self.levels[slots[:, 3]]

    @staticmethod
    def _place(z):
        """Where in the table's rows the mixed predictions are."""
        at = (np.clip(z, -7.999, 7.999) + 8) * ((APM_STEPS - 1) / 16)
        low = at.astype(np.int64)
        return low, at - low

    def mixed(self, x, gate):
        z = np.zeros(len(gate))
        for i in range(x.shape[1]):
            z += self.weights[:, i].take(gate) * x[:, i]
        np.clip(z, -_CLIP, _CLIP, out=z)
        return z, _squash(z)

    def predict(self, x, gate, so_far):
        z, p = self.mixed(x, gate)
        low, part = self._place(z)
        cell, table = so_far * APM_STEPS + low, self.apm.reshape(-1)
        q = table.take(cell) * (1 - part) + table.take(cell + 1) * part
        final = np.where(np.abs(z) < 7.9, 0.5 * p + 0.5 * q, p)
        return p, np.clip(final, 2.0 ** -22, 1 - 2.0 ** -22), low, part

    def learn(self, words: list[bytes], step: int = 24, rate: float = 0.005, apm_rate: float = 0.02) -> None:
        """Online: a few words are predicted, then weights and table move."""
        for at in range(0, len(words), step):
            slots, bits, so_far, _ = events(words[at:at + step])
            x, gate = self.inputs(slots, (bits.astype(np.int64), np.ones(len(bits))))
            place = np.tile(np.arange(8), len(bits) // 8)
            gate = gate * 8 + place
            p, _, low, part = self.predict(x, gate, so_far)
            err = bits - p
            now = rate / (1 + at / (len(words) / 4))
            np.add.at(self.weights, gate, now * err[:, None] * x)
            for cell, share in ((low, 1 - part), (low + 1, part)):
                np.add.at(self.apm, (so_far, cell), apm_rate * share * (bits - self.apm[so_far, cell]))
        np.clip(self.apm, 1e-4, 1 - 1e-4, out=self.apm)

    def learn_all(self, paths: Paths, words: list[bytes], c: np.ndarray, rate: float = 0.005, apm_rate: float = 0.02,
                  begun: Beginnings | None = None) -> None:
        """Online, from every word by its count: a word with more than the
        mean count comes as several copies, so no step hangs on one word."""
        begun = begun or Beginnings(words)
        rows = paths.rows(begun.codes)
        mean = c.sum() / len(c)
        k = np.ceil(c / mean).astype(np.int64)
        stream = np.repeat(np.arange(len(words)), k)
        weight = c / (k * mean)
        np.random.default_rng(7).shuffle(stream)
        sets, width = self.weights.shape
        end = 0
        for at in range(0, len(stream), STEP):
            if at == end:  # steps of a block of bounded size
                size = np.cumsum(begun.lengths[stream[at:at + STEP * 64]])
                end = at + STEP * max(1, int(np.searchsorted(size[STEP - 1::STEP], BLOCK_BYTES, "right")))
                some, lengths = begun.of(stream[at:end])
                block, byte, ends, first = Block(paths, rows.take(some, axis=1), 1), begun.byte[some], np.cumsum(lengths), at
            own = stream[at:at + STEP]
            lengths = begun.lengths[own]
            here = slice(ends[at - first] - lengths[0], ends[at - first + len(own) - 1])
            x, gate, bits, so_far = block.inputs(here, byte[here])
            z, p = self.mixed(x, gate)
            low, part = self._place(z)
            by = np.repeat(weight[own], lengths * 8)
            err = by * (bits - p)
            mass = np.bincount(gate, by, sets)
            now = rate / (1 + at / (len(stream) / 4)) * np.minimum(1, PER_STEP / np.maximum(mass, 1e-9))
            for i in range(width):
                self.weights[:, i] += now * np.bincount(gate, err * x[:, i], sets)
            cell = so_far * APM_STEPS + low
            share = np.concatenate([(1 - part) * by, part * by])
            cell = np.concatenate([cell, cell + 1])
            table = self.apm.reshape(-1)
            mass = np.bincount(cell, share, table.size)
            ones = np.bincount(cell, share * np.concatenate([bits, bits]), table.size)
            # as many moves of apm_rate as the cell has weight
            hit = np.flatnonzero(mass)
            mass = mass[hit]
            table[hit] += (1 - (1 - apm_rate) ** mass) * (ones[hit] / np.maximum(mass, 1e-9) - table[hit])
        np.clip(self.apm, 1e-4, 1 - 1e-4, out=self.apm)

    def score_counted(self, paths: Paths, words: list[bytes], begun: Beginnings | None = None) -> np.ndarray:
        """log10 probability of every coded word, from exact counts; each
        different beginning is predicted once."""
        begun = begun or Beginnings(words)
        lp = np.empty(len(begun.codes))
        for first in range(0, len(lp), BLOCK_BYTES):
            byte = begun.byte[first:first + BLOCK_BYTES]
            block = Block(paths, paths.rows(begun.codes[first:first + BLOCK_BYTES]))
            for at in range(0, len(byte), PER_SCORE):
                here = slice(at, min(at + PER_SCORE, len(byte)))
                x, gate, bits, so_far = block.inputs(here, byte[here])
                _, p, _, _ = self.predict(x, gate, so_far)
                lp[first + at:first + here.stop] = np.log10(np.where(bits == 1, p, 1 - p)).reshape(-1, 8).sum(axis=1)
        return begun.sums(lp)

    def score(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of every coded word, by the frozen model."""
        if self.counts is not None:
            self.freeze()
        out = np.empty(len(words))
        for at, end in parts(words):
            slots, bits, so_far, owner = events(words[at:end])
            sums = np.zeros(end - at)
            for lo in range(0, len(bits), 1 << 18):
                s = slice(lo, lo + (1 << 18))
                x, gate = self.frozen_inputs(slots[s])
                gate = gate * 8 + np.tile(np.arange(8), len(x) // 8)
                _, p, _, _ = self.predict(x, gate, so_far[s])
                sums += np.bincount(owner[s], np.log10(np.where(bits[s] == 1, p, 1 - p)), end - at)
            out[at:end] = sums
        return out


# ------------------------------------------------------------------ training

def tokens(text: bytes | None) -> list[bytes]:
    """Words and the end (an empty word)."""
    return [*(text or b"").lower().split(), b""]


def keys(words) -> np.ndarray:
    """64-bit hashes of words, as Spark's ``xxhash64`` gives them."""
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], dtype=np.uint64).view(np.int64)


def word_counts(docs: DataFrame, train: Column) -> DataFrame:
    """(word, c): every different word and its count in training rows."""
    def run(batches):
        known, rest = Counter(), set()

        def rows():
            rest.difference_update(known)
            words = [*known, *rest]
            c = np.zeros(len(words), dtype=np.int64)
            c[:len(known)] = np.fromiter(known.values(), np.int64, len(known))
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c)], ["word", "c"])
            known.clear()
            rest.clear()
            return batch
        for batch in batches:
            for text, use in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (known.update if use else rest.update)(tokens(text))
                if len(known) + len(rest) > FLUSH:
                    yield rows()
        if known or rest:
            yield rows()
    src = docs.select(F.col("text").cast("binary").alias("t"), train.alias("use"))
    return src.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def in_ranges(words: DataFrame) -> DataFrame:
    """(chunk, word, c): the words in ranges of about ``RANGE_BYTES``."""
    size = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    return saved(words.repartitionByRange(max(1, -(-size // RANGE_BYTES)), "word")
                 .select(F.spark_partition_id().alias("chunk"), "word", "c"))


def context_counts(words: DataFrame, joined: bool = False) -> DataFrame:
    """(ctx, byte, n): how often a byte follows a context in training rows,
    for all contexts of all words.  ``joined``: of the beginnings only those
    that several ranges may share."""
    def run(batches):
        if joined:
            batches = list(batches)  # a range
            shared = borders([w for b in batches for w in b.column("word").to_pylist()])
        codes, n, size = [], [], 0

        def rows():
            found, at = np.unique(np.concatenate(codes), return_inverse=True)
            sums = np.bincount(at, np.concatenate(n), len(found)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array((found >> np.uint64(8)).view(np.int64)), pa.array(
                (found & np.uint64(255)).astype(np.int32)), pa.array(sums)], ["ctx", "byte", "n"])
        for batch in batches:
            some, c = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(np.float64)
            begun = Beginnings(some)
            of = begun.counts(c)
            for o in range(len(ORDERS)):
                own = begun.codes[:, o]
                use = np.isin(own >> np.uint64(8), shared) if joined and not ORDERS[o] else slice(None)
                # most are there many times in a batch
                found, at = np.unique(own[use], return_inverse=True)
                codes.append(found)
                n.append(np.bincount(at, of[use], len(found)))
                size += len(found)
            if size > COUNT_FLUSH:
                yield rows()
                codes, n, size = [], [], 0
        if codes:
            yield rows()
    got = words.filter("c > 0").select("word", "c").mapInArrow(run, "ctx long, byte int, n long")
    # dealt by context at once: the sums and the join need no other exchange
    return saved(got.repartition("ctx").groupBy("ctx", "byte").agg(F.sum("n").alias("n")))


def needed_counts(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk, code, n): per range of words the counts that it cannot take
    from its own words."""
    def needed(batches):
        found, now, all_words = [], None, []
        for batch in batches:
            if batch.num_rows:
                now, some = batch.column("chunk")[0].as_py(), batch.column("word").to_pylist()
                found.append(np.unique(Beginnings(some).codes[:, :-1] >> np.uint64(8)))
                all_words += [min(some), max(some)]
        if found:
            ctx = np.unique(np.concatenate([*found, borders(all_words)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ctx), now, np.int32)), pa.array(ctx.view(np.int64))],
                                             ["chunk", "ctx"])
    need = words.select("chunk", "word").mapInArrow(needed, "chunk int, ctx long")
    return need.join(counts, "ctx").select("chunk", F.shiftleft("ctx", 8).bitwiseOR(F.col("byte").cast("long")).alias("code"), "n")


def with_counts(words: DataFrame, have: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on every range of words and the exact counts of its contexts:
    work(words, c, paths, beginnings) gives a table."""
    def run(left, right):
        some, c = left.column("word").to_pylist(), left.column("c").to_numpy()
        begun = Beginnings(some)
        own = ~np.isin(begun.codes[:, -1] >> np.uint64(8), borders(some))
        paths = Paths(np.concatenate([right.column("code").to_numpy().view(np.uint64), begun.codes[own, -1]]),
                      np.concatenate([right.column("n").to_numpy(), begun.counts(c)[own].astype(np.int64)]),
                      np.concatenate([begun.codes[~own, -1], *(np.unique(begun.codes[:, o]) for o in range(len(ORDERS) - 1))]))
        return work(some, c, paths, begun)
    return words.groupBy("chunk").cogroup(have.groupBy("chunk")).applyInArrow(run, schema)


def train(words: DataFrame, have: DataFrame) -> Model:
    """Weights and refinement, learnt in every range from all of its training
    words; their means by training tokens."""
    def learn(some, c, paths, begun):
        if not some:  # a range without training words
            return pa.table({"v": pa.array([], pa.list_(pa.float64())), "by": pa.array([], pa.float64())})
        model = Model()
        model.learn_all(paths, some, c.astype(np.float64), begun=begun)
        by = float(c.sum())
        return pa.table({"v": pa.array([np.concatenate([model.weights.ravel(), model.apm.ravel()]) * by]), "by": pa.array([by])})

    def add(batches):
        total, mass = 0.0, 0.0
        for batch in batches:
            for v, by in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total, mass = total + v.values.to_numpy(), mass + by
        if mass:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([mass])], ["v", "by"])
    # a row per range, then one per part: nothing to the driver that grows
    schema = "v array<double>, by double"
    got = with_counts(words.filter("c > 0"), have, learn, schema).repartition(SUM_PARTS).mapInArrow(add, schema).toArrow()
    model = Model()
    if got.num_rows:
        flat = sum(v.values.to_numpy() for v in got.column("v")) / sum(got.column("by").to_pylist())
        model.weights = flat[:model.weights.size].reshape(model.weights.shape)
        model.apm = flat[model.weights.size:].reshape(model.apm.shape)
    return model


def score_words(words: DataFrame, counts: DataFrame, model: Model, have: DataFrame | None = None) -> DataFrame:
    """(word, c, lp): log10 probability of every different word; ``have``: its
    ``needed_counts``, if they are there."""
    def run(some, c, paths, begun):
        return pa.table({"word": pa.array(some, pa.binary()), "c": pa.array(c),
                         "lp": pa.array(model.score_counted(paths, some, begun))})
    return with_counts(words, needed_counts(words, counts) if have is None else have, run, "word binary, c long, lp double")


def score(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, bits_per_byte."""
    out = fold(F.col("doc_id"), folds) == held
    words = in_ranges(saved(word_counts(docs, ~out)))
    size = words.agg(F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.sum("c").alias("n")).first()
    v, n = size["v"], size["n"] or 0
    counts = context_counts(words, joined=True)
    have = saved(needed_counts(words, counts))
    scored = score_words(words, counts, train(words, have), have)
    source = docs.select("doc_id", F.col("text").cast("binary").alias("t"), out.alias("held_out"),
                         F.spark_partition_id().alias("part"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def chunks(batches):
        """(chunk of every row, batch): a new chunk after CHUNK_BYTES of text."""
        chunk, size = 0, 0
        for batch in batches:
            own, at = np.empty(batch.num_rows, dtype=np.int64), batch.column(3).to_numpy()
            for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
                if size > CHUNK_BYTES:
                    chunk, size = chunk + 1, 0
                size += (n or 0) + 1
                own[i] = (int(at[i]) << 32) + chunk
            yield own, batch

    def deal(batches):
        for own, batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(own), *batch.columns[:3]], ["chunk", "doc_id", "t", "held_out"])

    def vocabulary(batches):
        now, found = None, set()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), now)), pa.array(np.sort(keys(found)))],
                                              ["chunk", "h"])
        for own, batch in chunks(batches):
            for c, t in zip(own.tolist(), batch.column(1).to_pylist(), strict=True):
                if c != now and found:
                    yield rows()
                    found.clear()
                now = c
                found.update(tokens(t))
        if found:
            yield rows()

    # both read the same partitions in the same order, so their chunks agree
    dealt = source.mapInArrow(deal, f"chunk long, doc_id {id_type}, t binary, held_out boolean")
    need = source.mapInArrow(vocabulary, "chunk long, h long")
    # words travel as their 64-bit hash
    have = need.join(scored.select(F.xxhash64("word").alias("h"), "c", F.col("lp").cast("float").alias("lp")), "h")
    base_under = np.log10(n + 0.1 * (v + 1))

    def look_up(left, right):
        index: defaultdict = defaultdict()
        index.default_factory = index.__len__  # words by their first place
        ids = []
        for t in left.column("t").to_pylist():
            some = tokens(t)
            ids.append(np.fromiter(map(index.__getitem__, some), np.int32, len(some)))
        h = right.column("h").to_numpy()
        order = np.argsort(h)
        at = order[np.searchsorted(h, keys(index), sorter=order)]
        coded = np.fromiter(map(len, index), np.int64, len(index)) + 1
        c, lp = right.column("c").to_numpy()[at], right.column("lp").to_numpy()[at].astype(np.float64)
        base, known = np.log10(c + 0.1) - base_under, c > 0
        rows = {"n_tokens": [], "n_known": [], "base_score": [], "score": [], "bits_per_byte": []}
        for at in ids:
            s = float(lp[at].sum())
            for k, x in zip(rows, (len(at), int(known[at].sum()), float(base[at].sum()), s,
                                   -s / np.log10(2) / int(coded[at].sum())), strict=True):
                rows[k].append(x)
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"),
                         "n_tokens": pa.array(rows["n_tokens"], pa.int64()), "n_known": pa.array(rows["n_known"], pa.int64()),
                         "train_tokens": pa.array([n] * left.num_rows, pa.int64()),
                         **{k: pa.array(rows[k], pa.float64()) for k in ("base_score", "score", "bits_per_byte")}})

    return dealt.groupBy("chunk").cogroup(have.groupBy("chunk")).applyInArrow(
        look_up, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                 "base_score double, score double, bits_per_byte double")


def op8(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
