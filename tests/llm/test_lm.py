"""LM scoring: base score against plain Python, the model's own properties."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rankflow.llm import lm as L

from .conftest import clash


def slow(rows):
    """(doc_id, held, n_tokens, n_known, N, base_score) per row, sorted."""
    def toks(text):
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    c = Counter(t for (_, text), h in zip(rows, held, strict=True) if not h for t in toks(text))
    n, v = sum(c.values()), len(c)
    return [(d, h, len(toks(t)), sum(x in c for x in toks(t)), n,
             sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in toks(t))) for (d, t), h in zip(rows, held, strict=True)]


def check(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    have = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
    for a, b in zip(have, sorted(slow(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0 for r in got)


def test_query(spark, sf, sf_docs):
    got = L.op8(spark, sf).collect()
    check(got, sf_docs)
    # far better than eight bits a byte on held-out texts, and no training text is dearer
    held = [r.bits_per_byte for r in got if r.held_out]
    assert np.mean(held) < 3.5


def test_chunks_agree_and_odd_rows(spark, odd, no_docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    one = L.score(clash(odd, "word", "c", "chunk", "held_out", "t", "lp")).collect()
    check(one, rows)
    monkeypatch.setattr(L, "CHUNK_BYTES", 10)
    many = L.score(odd).collect()
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in one) == sorted(
        (str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in many)
    assert L.score(no_docs).count() == 0


def test_without_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    df = spark.createDataFrame([(i, "ab c") for i in held], "doc_id long, text string")
    for r in L.score(df).collect():
        assert r.n_known == 0 and r.train_tokens == 0 and r.base_score == pytest.approx(0)
        assert r.bits_per_byte == pytest.approx(1 * 8, rel=0.01)


def _model(words):
    counts = np.zeros((L.SLOTS, 2), dtype=np.float32)
    slots, bits, _, _ = L.events(words)
    for o in range(len(L.ORDERS)):
        np.add.at(counts, (slots[:, o], bits), 1)
    m = L.Model(counts)
    m.learn(words)
    return m


def test_probabilities_of_a_code_sum_to_one():
    """All codes of one byte, and all longer ones by their first byte."""
    m = _model([b"aa", b"ab", b"abc", b"", b"zebra"] * 40)
    total = 0.0
    for byte in range(256):
        slots, bits, so_far, _ = L.events([bytes([byte])])
        first = slice(0, 8)
        x, gate = m.inputs(slots[first])
        _, p, _, _ = m.predict(x, gate * 8 + np.arange(8), so_far[first])
        total += np.prod(np.where(bits[first] == 1, p, 1 - p))
    assert total == pytest.approx(1)


def test_context_of_a_word_does_not_depend_on_its_neighbours():
    words = [b"abc", b"", b"x" * 3000, b"\x00\xff", b"abcd"]
    together, _, _, owner = L.events(words)
    for i, w in enumerate(words):
        alone, _, _, _ = L.events([w])
        assert (together[owner == i] == alone).all()


def test_frequent_words_are_likelier():
    words = [b"common"] * 300 + [b"rare"] * 3 + [b"w%d" % i for i in range(100)]
    np.random.default_rng(0).shuffle(words)
    common, rare, never = _model(words).score([b"common", b"rare", b"unseen"])
    assert common > rare > never
    assert common == pytest.approx(math.log10(300 / 403), abs=0.5)


def test_parts_cover_all_words(monkeypatch):
    monkeypatch.setattr(L, "PART_BYTES", 10)
    words = [b"a" * n for n in (0, 3, 50, 1, 9, 10, 11, 0)]
    assert [w for a, e in L.parts(words) for w in words[a:e]] == words
    assert list(L.parts([])) == []


def _slow_paths(words):
    """Counter of (order, context, bits so far) and of the same with the next bit, for all training words."""
    n = Counter()
    for w, c in words.items():
        code = w + b" "
        for i, byte in enumerate(code):
            for order in (1, 2, 3, 4, 0):
                ctx = (order, code[:i] if order == 0 or i < order else (code[i - order:i],))
                for j in range(9):
                    n[ctx, f"{byte:08b}"[:j]] += c
    return n


def test_context_counts_are_exact_and_grow_with_the_words(spark):
    """More contexts than the hash slots of order 1 hold, each with its own counts, in several ranges."""
    rng = np.random.default_rng(3)
    some = {bytes(rng.integers(97, 123, rng.integers(0, 9)).astype(np.uint8)): int(rng.integers(0, 4)) for _ in range(3000)}
    words = L.in_ranges(spark.createDataFrame([(bytearray(w), c) for w, c in some.items()], "word binary, c long"))
    counts = L.context_counts(words)
    slow = _slow_paths({w: c for w, c in some.items() if c})
    assert counts.count() == sum(1 for (_, bits), _ in slow.items() if len(bits) == 8)
    seen, same, bits, _, owner = L.Paths(*_collected(counts), np.unique(L.codes_of(*_coded(list(some))))).of(list(some))
    at = 0
    for w in some:
        code = w + b" "
        for i, byte in enumerate(code):
            for j in range(8):
                for o, order in enumerate((1, 2, 3, 4, 0)):
                    ctx = (order, code[:i] if order == 0 or i < order else (code[i - order:i],))
                    assert seen[at, o] == slow[ctx, f"{byte:08b}"[:j]] and same[at, o] == slow[ctx, f"{byte:08b}"[:j + 1]]
                at += 1


def _coded(words):
    b, _, hashes = L.contexts(words)
    return b, hashes


def _collected(counts):
    t = counts.toArrow()
    ctx, byte = t.column("ctx").to_numpy().astype(np.uint64), t.column("byte").to_numpy().astype(np.uint64)
    return ctx << np.uint64(8) | byte, t.column("n").to_numpy().astype(np.float64)


def test_ranges_share_their_counts(spark, monkeypatch):
    """Scores with given weights do not depend on how the words are dealt."""
    some = [(bytearray(b"w%d" % i), i % 3) for i in range(500)] + [(bytearray(b""), 70)]
    words = spark.createDataFrame(some, "word binary, c long")
    scores = []
    for size in (10 ** 9, 300):
        monkeypatch.setattr(L, "RANGE_BYTES", size)
        ranged = L.in_ranges(words)
        got = L.score_words(ranged, L.context_counts(ranged), L.Model()).collect()
        scores.append({bytes(r.word): (r.c, round(r.lp, 9)) for r in got})
        assert (ranged.select("chunk").distinct().count() > 1) == (size == 300)
    assert scores[0] == scores[1] and len(scores[0]) == 501


def test_every_training_word_moves_the_weights(spark):
    """Words far beyond any sample's size, told apart only by rare ones."""
    some = {b"common": 1_000_000} | {b"r%d" % i: 1 for i in range(50)}
    words = list(some)
    c = np.array(list(some.values()), dtype=np.float64)
    b, lengths, hashes = L.contexts(words)
    codes = L.codes_of(b, hashes)
    paths = L.Paths(codes.ravel(), np.repeat(c, lengths * len(L.ORDERS)), codes.ravel()[:0])
    with_all, without = L.Model(), L.Model()
    with_all.learn_all(paths, words, c)
    without.learn_all(paths, words[:-1], c[:-1])
    assert not np.array_equal(with_all.weights, without.weights)


def _some_words(n, seed=5):
    rng = np.random.default_rng(seed)
    some = {bytes(rng.integers(97, 103, rng.integers(0, 12)).astype(np.uint8)): int(rng.integers(0, 4)) for _ in range(n)}
    return some | {b"ab\x00c": 2, b"ab": 5, b"\xff" * 50: 1}


def test_ranges_take_whole_words_from_their_own_words(spark, monkeypatch):
    """Only short contexts and the beginnings of border words are joined, and the counts are all there."""
    some = _some_words(2000)
    words = spark.createDataFrame([(bytearray(w), c) for w, c in some.items()], "word binary, c long")
    monkeypatch.setattr(L, "RANGE_BYTES", 2000)
    ranged = L.in_ranges(words)
    every, joined = L.context_counts(ranged), L.context_counts(ranged, joined=True)
    assert joined.count() < 0.7 * every.count()
    a, b = (L.score_words(ranged, counts, L.Model()) for counts in (every, joined))
    a, b = ({bytes(r.word): (r.c, round(r.lp, 9)) for r in x.collect()} for x in (a, b))
    assert a == b and len(a) == len(some)
    # against one set of all counts
    found, own = list(some), np.array(list(some.values()), dtype=np.float64)
    begun = L.Beginnings(found)
    codes, n = begun.codes.T.ravel(), np.tile(begun.counts(own), len(L.ORDERS))
    lp = L.Model().score_counted(L.Paths(codes, n, codes[:0]), found)
    assert {w: round(v, 9) for w, v in zip(found, lp.tolist(), strict=True)} == {w: v for w, (_, v) in a.items()}


def test_a_range_is_held_in_rows_per_count():
    """Codes that alone follow their context share a row of counts; nine numbers of eight bytes a code were too much."""
    words = [bytes([97 + i % 26, 97 + i // 26 % 26, 97 + i // 676]) * 30 for i in range(5000)]
    begun = L.Beginnings(words)
    codes = np.unique(begun.codes[:, -1])
    paths = L.Paths(codes, np.ones(len(codes)), codes[:0])
    assert paths.n.nbytes + paths.row.nbytes + paths.codes.nbytes < 16 * len(codes)


def test_each_beginning_is_predicted_once(monkeypatch):
    words = [b"beginning%d" % i for i in range(1000)]
    begun = L.Beginnings(words)
    codes = begun.codes.T.ravel()
    paths, predicted, predict = L.Paths(codes, np.ones(len(codes)), codes[:0]), [], L.Model.predict
    monkeypatch.setattr(L.Model, "predict", lambda self, x, *a: predicted.append(len(x)) or predict(self, x, *a))
    L.Model().score_counted(paths, words)
    assert sum(predicted) < 8 * sum(len(w) + 1 for w in words) / 4


def test_weights_of_ranges_are_a_row_each(spark, monkeypatch):
    """However many ranges there are, the driver gets a bounded number of rows, with the mean of all ranges."""
    monkeypatch.setattr(L, "RANGE_BYTES", 300)
    words = L.in_ranges(spark.createDataFrame([(bytearray(b"w%d" % i), 1 + i % 3) for i in range(600)], "word binary, c long"))
    have = L.needed_counts(words, L.context_counts(words, joined=True))
    n = words.select("chunk").distinct().count()
    assert n > 5
    rows, was = [], L.with_counts
    monkeypatch.setattr(L, "with_counts", lambda *a: rows.append(was(*a)) or rows[-1])
    model = L.train(words, have)
    each = rows[0].collect()
    assert len(each) == n
    mean = sum(np.array(r.v) for r in each) / sum(r.by for r in each)
    assert np.allclose(np.concatenate([model.weights.ravel(), model.apm.ravel()]), mean, rtol=1e-12)
