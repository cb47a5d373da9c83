"""Quality and toxicity: held-out accuracy, contracts and odd rows."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from rankflow.llm import quality as Q
from rankflow.llm import toxicity as T
from rankflow.llm.labelled import sample

from .conftest import clash


@pytest.fixture(scope="module")
def labelled():
    """(doc_id, text, quality, toxic) of the labelled documents at sf0.1."""
    place = "/root/testdata/sf0.1"
    text = dict(zip(*(pq.read_table(f"{place}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text")),
                    strict=True))
    t = pq.read_table(f"{place}/labels.parquet").to_pylist()
    return [(r["doc_id"], (text[r["doc_id"]] or "").encode(), r["quality"], r["toxic"]) for r in t]


def split(labelled, folds, held, k):
    inside = [r for r in labelled if zlib.crc32(str(r[0]).encode()) % folds != held]
    outside = [r for r in labelled if zlib.crc32(str(r[0]).encode()) % folds == held]
    rows = [r for y in (0, 1) for r in [x for x in inside if x[k] == y][:1500]]
    return rows, outside


def test_quality_on_held_out_texts(labelled):
    rows, outside = split(labelled, 4, 2, 2)
    rows = [rows[i] for i in np.random.default_rng(0).permutation(len(rows))]
    m = Q.fit([r[1] for r in rows], [r[2] for r in rows])
    got = np.array([m.score(r[1]) >= 0.7 for r in outside])
    want = np.array([r[2] == 1 for r in outside])
    assert (got == want).mean() > 0.98
    assert got[want].mean() > 0.995          # good texts stay
    assert 0 <= m.score(b"") <= 1


def test_quality_ratio_scales_and_separates():
    good, bad = [b"a calm line of plain words here"] * 12, [b"BUY!! NOW!! $$$ %%% !!"] * 12
    m = Q.fit(good + bad, [1] * 12 + [0] * 12)
    assert m.score(b"another calm line of words") > 0.5 > m.score(b"WIN!! BIG!! $$$")
    assert Q.fit(good, [1] * 12).score(b"x") == 0.5


def test_quality_features_of_long_texts_are_those_of_their_parts():
    text = b"plain words and MORE!! | " * 200
    whole = set(Q.features(text).tolist())
    old, Q.PART = Q.PART, 512
    try:
        assert set(Q.features(text).tolist()) >= {i for i in whole if i < 1 << Q.BITS}
    finally:
        Q.PART = old


def test_toxicity_on_held_out_texts(labelled):
    rows, outside = split(labelled, 5, 0, 3)
    rows = [rows[i] for i in np.random.default_rng(0).permutation(len(rows))]
    m = T.fit([r[1] for r in rows], [r[3] for r in rows])
    got = np.array([m.score(r[1]) >= 0.5 for r in outside])
    want = np.array([r[3] == 1 for r in outside])
    assert (got == want).mean() > 0.97 and got[want].mean() > 0.8
    assert got[~want].mean() < 0.01          # clean texts are left alone
    # misspellings share n-grams with what they come from
    assert m.score(b"you are such an idiiot and a mooron you losser") > 0.5
    assert m.score(b"the house by the river is old and calm " * 3) < 0.5
    # a passage counts wherever it stands in a long text
    clean = next(r[1] for r in outside if r[3] == 0 and len(r[1]) > 2000)
    assert m.score(clean + b" worthless pathetic idiot stupid scum " + clean) > 0.5


def test_toxicity_blocks_agree_across_parts():
    text = b" ".join(b"word%d" % i for i in range(T.PART_WORDS // 100))
    old = T.PART_WORDS
    try:
        whole = [s for ids, starts, sizes in T.blocks(text) for s in sizes]
        T.PART_WORDS = T.BLOCK * 5
        parts = [s for ids, starts, sizes in T.blocks(text) for s in sizes]
        assert sum(parts) == pytest.approx(sum(whole), rel=0.02)
    finally:
        T.PART_WORDS = old
    assert T.fit([b"a"], [1]).score(b"a") == 0.5


@pytest.mark.parametrize(("query", "folds", "held", "cut"), [(Q.op6, 4, 2, 0.7), (T.op10, 5, 0, 0.5)])
def test_queries(spark, sf, sf_docs, query, folds, held, cut):
    got = query(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in sf_docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    again = {r.doc_id: r.score for r in query(spark, sf).collect()}
    assert again == {r.doc_id: r.score for r in got}


@pytest.mark.parametrize("query", [Q.op6, T.op10])
def test_odd_rows(spark, odd, no_docs, tmp_path, query):
    labels = spark.createDataFrame([(None, 1, 1), (1, 1, 0), (2, 0, 1), (3, None, None), (4, 1, 0), (4, 0, 1), (5, 1, 0),
                                    (8, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    clash(labels, "y", "h").write.parquet(f"{tmp_path}/odd/labels.parquet")
    clash(odd, "score", "t", "y", "h", "held_out").write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = query(spark, f"{tmp_path}/odd").collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert query(spark, f"{tmp_path}/none").count() == 0


def test_sample_is_bounded_and_held_out(spark):
    docs = spark.createDataFrame([(i % 90, f"t{i}" * (1 + i % 5)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    rows = sample(docs, labels, "quality", 4, 2, 10, 8).collect()
    texts = [bytes(r.t) for r in rows]
    assert 0 < len(rows) <= 20 and all(len(t) <= 8 for t in texts)
    held = {f"t{i}" for i in range(200) if zlib.crc32(str(i % 90).encode()) % 4 == 2}
    assert not {t.decode() for t in texts} & held


def labelled_docs(spark, n, text, extra=()):
    docs = [(i, text(i)) for i in range(n)] + list(extra)
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)], "doc_id long, quality int, toxic int"))


def test_a_repeated_id_takes_one_place(spark):
    docs, labels = labelled_docs(spark, 200, lambda i: f"text {i}", [(2, "text 2")] * 3000 + [(4, f"other {k}") for k in range(50)])
    got = sample(docs, labels, "quality", 4, 2, 40, 1000).collect()
    assert [sum(r.y == y for r in got) for y in (0, 1)] == [40, 40]
    assert len({bytes(r.t) for r in got}) == 80
    again = sample(docs.repartition(7), labels.repartition(3), "quality", 4, 2, 40, 1000).collect()
    assert sorted((bytes(r.t), r.y) for r in got) == sorted((bytes(r.t), r.y) for r in again)


def test_ids_with_long_texts_do_not_take_places(spark):
    docs, labels = labelled_docs(spark, 400, lambda i: f"text {i}" if i % 4 < 2 else "long " * 400)
    got = sample(docs, labels, "toxic", 5, 0, 60, 1000).collect()
    assert [sum(r.y == y for r in got) for y in (0, 1)] == [60, 60]


def test_quality_stage_keeps_all_where_nothing_can_be_learnt(spark):
    docs, labels = labelled_docs(spark, 40, lambda i: f"long text {i} " * 100)
    with pytest.warns(RuntimeWarning, match="no model"):
        assert Q.keep(docs, labels, max_bytes=100).count() == 40
    with pytest.warns(RuntimeWarning, match="no model"):
        assert Q.keep(docs, labels.filter("quality = 1")).count() == 40
    with pytest.warns(RuntimeWarning, match="no model"):
        assert T.train(docs, labels.limit(0)).score(b"x") == 0.5
