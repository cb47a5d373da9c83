"""The pipeline against brute-force versions of its stages."""

import re
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from .conftest import clash
from .test_mixing import check_mix
from .test_secrets import PATTERN
from .test_simhash import slow_groups, slow_print


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """The output of every stage, written and read again."""
    import corpus_pipeline as P
    place = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_run_gives_the_last_stage(spark, sf, steps):
    import corpus_pipeline as P
    cols = ["doc_id", "text", "source", "copy"]
    assert sorted(map(str, P.run(spark, sf).select(cols).collect())) == sorted(map(str, steps[-1].select(cols).collect()))


def test_columns(spark, sf, steps):
    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(df.columns == names for df in steps[:-1])
    assert steps[-1].columns == [*names, "copy"]


def test_quality_keeps_good_texts(spark, sf, steps):
    before = texts(spark.read.parquet(f"{sf}/documents.parquet"))
    kept = texts(steps[0])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [d for d in before if labels.get(d) == 1]
    bad = [d for d in before if labels.get(d) == 0]
    assert sum(d in kept for d in good) >= 0.99 * len(good)
    assert sum(d in kept for d in bad) <= 0.1 * len(bad) + 1
    assert all(before[d] == t for d, t in kept.items())


def test_one_of_each_group_stays(steps):
    before = sorted(texts(steps[0]).items())
    prints = [(d, slow_print(t, 3)) for d, t in before]
    groups = slow_groups(prints, 2)
    assert texts(steps[1]) == {d: t for (d, t), g in zip(before, groups, strict=True) if d == g}


def test_leaked_documents_go(spark, sf, steps):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = texts(steps[1]), texts(steps[2])
    leaked = {d for d, t in before.items() if any(x in (t or "") for x in items)}
    assert set(after) == set(before) - leaked
    assert all(before[d] == t for d, t in after.items())


def test_secrets_are_redacted(steps):
    before, after = texts(steps[2]), texts(steps[3])
    assert set(before) == set(after)
    assigned = re.compile(r"(?:password|token|secret)\s?=\s?\"?$")
    for d, t in before.items():
        spans = [m for m in PATTERN.finditer(t or "") if assigned.search(t[:m.start()]) or m[0].startswith("AKIA")]
        want = t
        for m in reversed(spans):
            kind = "aws_key" if m[0].startswith("AKIA") else "assigned"
            want = f"{want[:m.start()]}[SECRET:{kind}]{want[m.end():]}"
        assert after[d] == want


def test_mix_near_targets(steps):
    rows = [(r.doc_id, r.text, r.source) for r in steps[3].collect()]
    taken = defaultdict(int)
    for r in steps[4].collect():
        taken[r.doc_id] += 1
    check_mix(rows, {d: n for d, n in taken.items()})


@pytest.mark.parametrize("k", range(5))
def test_odd_and_no_rows(spark, sf, odd, no_docs, k):
    import corpus_pipeline as P
    name, stage = P.STAGES[k]
    wide = clash(odd, "score", "scan", "copy", "th", "fp", "n", "d", "key", "size", "label")
    out = stage(spark, wide, sf)
    assert out.columns[:len(wide.columns)] == wide.columns
    out.write.format("noop").mode("overwrite").save()
    assert stage(spark, no_docs, sf).count() == 0


def test_empty_labels_and_benchmark(spark, odd, tmp_path):
    import corpus_pipeline as P
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd.filter("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    # without labels nothing is known to be bad
    with pytest.warns(RuntimeWarning, match="no model"):
        assert P.quality_stage(spark, odd, str(tmp_path)).count() == odd.count()
    assert P.decontamination_stage(spark, odd, str(tmp_path)).count() == odd.count()
    with pytest.warns(RuntimeWarning, match="no model"):
        done = P.run(spark, str(tmp_path))
    # all but the near copy of each group and what the mix does not take
    assert {r.doc_id for r in done.collect()} <= set(range(1, 9)) and done.count() > 0


@pytest.mark.parametrize("k", [1, 4])
def test_map_and_dotted_columns(spark, sf, odd, k):
    import corpus_pipeline as P
    wide = odd.withColumns({"a.b": F.lit(1), "m": F.create_map(F.lit("k"), F.lit(2))})
    out = P.STAGES[k][1](spark, wide, sf)
    assert out.columns[:7] == wide.columns
    rows = [r.asDict() for r in out.collect()]
    assert rows and all(r["a.b"] == 1 and r["m"] == {"k": 2} for r in rows)


def test_only_the_last_stage_output_stays(spark, sf, tmp_path):
    import corpus_pipeline as P
    kept = spark.sparkContext.getCheckpointDir()
    before = set(Path(kept.removeprefix("file:")).glob("pipeline-*"))
    rows = P.run(spark, sf).count()
    new = set(Path(kept.removeprefix("file:")).glob("pipeline-*")) - before
    assert rows and [sorted(p.name for p in d.iterdir()) for d in new] == [["4-mix"]]
