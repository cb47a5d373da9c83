"""Graphs and snapshots kept as bucketed folders; adjacency in parts."""

import random

import pytest
from pyspark.sql import functions as F

from rankflow.operators import graph as G
from rankflow.plans import loop as L
from rankflow.plans.tables import read_bucketed, write_bucketed
from rankflow.sinks import write_adjacency_tsv, write_vertex_json
from rankflow.sources.text import (adjacency_graph, parse_adjacency_tsv, parse_vertex_json, read_lines,
                                   vertex_json_graph)


def edges_of(spark, hub=300, seed=2):
    """A hub with a third of the edges, one edge many times, a few sinks."""
    rnd = random.Random(seed)
    rows = [(0, rnd.randrange(1, 90)) for _ in range(hub)] + [(7, 8)] * 60
    rows += [(rnd.randrange(1, 60), rnd.randrange(0, 90)) for _ in range(2 * hub)]
    return spark.createDataFrame(rows, "src bigint, dst bigint"), rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ranks(res):
    return {r.id: r.rank for r in res.ranks.collect()}


def test_bucketed_folder_round_trip_without_exchange(spark, tmp_path):
    path = str(tmp_path / "it's a folder")
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("a.b"))
    for shift in (0, 5):        # written twice: the second takes the first's place
        write_bucketed(df.withColumn("id", F.col("id") + shift).repartition(4, "id"), path, 4, "id")
    got = read_bucketed(spark, path, 4, "id")
    assert got.agg(F.min("id"), F.max("id"), F.count("*")).first()[:] == (5, 1004, 1000)
    assert "a.b" in got.columns
    with L._LoopConf(spark, 4, adaptive=False):
        assert "Exchange" not in plan_of(got.groupBy("id").count())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rankflow_")]


@pytest.mark.parametrize("salt_chunk", [20, 50_000])
def test_saved_graph_needs_no_layout_job(spark, tmp_path, salt_chunk):
    edges, _ = edges_of(spark)
    g = L.prepare(edges, num_partitions=4, salt_chunk=salt_chunk)
    want = ranks(L.run(g))
    base = str(tmp_path / "graph")
    L.save_graph(g, base)
    g.release()
    back = L.load_graph(spark, base)
    assert (back.num_vertices, back.num_hot, back.num_partitions) == (g.num_vertices, g.num_hot, 4)
    assert (back.hot_edges is not None) == (salt_chunk == 20)
    with L._LoopConf(spark, 4, adaptive=False):
        plan = plan_of(L.step(back, L.initial_state(back)))
    # the votes of hot sources and the sums move, as ever; no stored side does
    assert plan.count("ENSURE_REQUIREMENTS") == (2 if salt_chunk == 20 else 1), plan
    assert "REPARTITION" not in plan
    assert ranks(L.run(back)) == want
    back.release()


def test_graph_for_the_broadcast_join_is_not_saved(spark, tmp_path, golden_edges):
    with pytest.raises(ValueError):
        L.save_graph(L.prepare(golden_edges, broadcast=True, broadcast_bytes=1 << 20), str(tmp_path / "g"))


def test_resume_reads_the_layout_and_the_markers_once(spark, tmp_path, monkeypatch):
    edges, _ = edges_of(spark)
    g = L.prepare(edges, num_partitions=4)
    whole, base = L.run(g), str(tmp_path / "snap")
    L.run(g, max_iter=3, snapshot_dir=base)
    reads, seen = [], []
    listing, stepping = L._list_snapshots, L.step
    monkeypatch.setattr(L, "_list_snapshots", lambda *a: reads.append(1) or listing(*a))
    monkeypatch.setattr(L, "step", lambda g, state, *a: seen.append(plan_of(state)) or stepping(g, state, *a))
    res = L.run(g, snapshot_dir=base, resume=True)
    assert len(reads) == 1
    assert "Exchange" not in seen[0] and "parquet" in seen[0].lower()
    assert ranks(res) == ranks(whole) and res.iterations == whole.iterations
    # a graph of another layout still resumes, through one exchange
    other = L.prepare(edges, num_partitions=3)
    assert ranks(L.run(other, snapshot_dir=base, resume=True, tol=None, max_iter=res.iterations)) == ranks(whole)


def test_markers_without_buckets_are_read(spark, tmp_path, golden_edges):
    g, base = L.prepare(golden_edges, num_partitions=2), str(tmp_path / "snap")
    state = L.run(g, tol=None, max_iter=2).state
    state.write.parquet(f"{base}/iter=2")
    spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0)], L.HISTORY_SCHEMA).write.parquet(f"{base}/manifest/part=2")
    got = L.run(g, snapshot_dir=base, resume=True)
    assert ranks(got) == ranks(L.run(g))


@pytest.mark.parametrize("part_edges", [1, 10, 10_000])
@pytest.mark.parametrize("order", [None, "pos"])
def test_parts_make_the_adjacency(spark, part_edges, order):
    edges, _ = edges_of(spark)
    edges = edges.withColumn("pos", F.monotonically_increasing_id()).persist()
    got = {}
    for r in G.adjacency_parts(edges, order, part_edges).orderBy("id", "part").collect():
        assert len(r.nbrs) < 2 * part_edges
        got.setdefault(r.id, []).extend(r.nbrs)
    want = {r.id: r.nbrs for r in G.adjacency(edges, order).collect()}
    assert got == want


def test_parts_of_no_edges_and_null_ends(spark):
    none = spark.createDataFrame([(None, 1), (2, None), (None, None)], "src bigint, dst bigint")
    assert G.adjacency_parts(none).count() == 0


def test_a_hot_vertex_is_spread_over_slices(spark):
    """The slices are cut inside the hub: no task sorts all its edges."""
    hub = spark.range(20_000).select(F.lit(1).cast("bigint").alias("src"), (F.col("id") + 2).alias("dst"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        slices = G.adjacency_parts(hub, part_edges=1000).where("size(nbrs) > 0").select(
            F.shiftright("part", 32).alias("s"), F.size("nbrs").alias("n")).groupBy("s").agg(F.sum("n").alias("n"))
        sizes = [r.n for r in slices.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) >= 3 and max(sizes) < 10_000 and sum(sizes) == 20_000


def test_parts_as_text(spark, tmp_path):
    edges, rows = edges_of(spark)
    parts = G.adjacency_parts(edges, part_edges=25)
    tsv, js = str(tmp_path / "tsv"), str(tmp_path / "json")
    write_adjacency_tsv(parts, tsv)
    write_vertex_json(parts, js)
    lines = read_lines(spark, tsv)
    assert lines.where("length(value) > 400").count() == 0
    back, verts = adjacency_graph(parse_adjacency_tsv(lines))
    assert sorted((int(r.src), int(r.dst)) for r in back.collect()) == sorted(rows)
    jback, _ = vertex_json_graph(parse_vertex_json(read_lines(spark, js)))
    assert sorted((r.src, r.dst) for r in jback.collect()) == sorted(rows)
    # one part a vertex: the text of K1
    whole = str(tmp_path / "whole")
    write_adjacency_tsv(G.adjacency_parts(edges), whole)
    plain = str(tmp_path / "plain")
    write_adjacency_tsv(G.adjacency(edges), plain)
    text = lambda p: sorted(r.value for r in read_lines(spark, p).collect())
    assert text(whole) == text(plain)
    # ranks from the lines of parts are those of the edges
    ids = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    assert ranks(L.rank_until(back, vertices=verts, start=0.0, tol=None, max_iter=2)).keys() == \
        ranks(L.rank_until(ids, tol=None, max_iter=1)).keys()
