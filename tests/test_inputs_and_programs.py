"""Declared vertices and start ranks, order-free sums, general vertex
programs, rejected lines."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rankflow.cli import main
from rankflow.functions import exact_sum
from rankflow.operators.vertex_program import vertex_program
from rankflow.plans import loop as L
from rankflow.sources import text as S


def as_dict(df, *cols):
    cols = cols or ("rank",)
    return {r["id"]: r[cols[0]] if len(cols) == 1 else tuple(r[c] for c in cols) for r in df.collect()}


def batch_reference(lines, updates):
    """The batch job's rule on ``id, rank, targets`` rows: votes go out with
    the row's rank; a target without a row starts from 0 and never votes."""
    rows = {i: (float(r), list(t)) for i, r, t in lines}
    old = {i: r for i, (r, _) in rows.items()}
    for _, ts in list(rows.values()):
        for t in ts:
            old.setdefault(t, 0.0)
    diffs = []
    for _ in range(updates):
        got = dict.fromkeys(old, 0.0)
        for i, (_, ts) in rows.items():
            for t in ts:
                got[t] += old[i] / len(ts)
        new = {i: 0.15 + 0.85 * s for i, s in got.items()}
        diffs.append(sum(int(abs(new[i] - old[i]) * 100000) for i in new) / 100000)
        old = new
    return old, diffs


LINES = [("1", 5.0, ["2", "2", "7"]), ("2", 1.0, ["3"]), ("3", 1.0, []), ("9", 4.5, []), ("4", 0.25, ["1", "4"])]


def tsv(spark, lines):
    return spark.createDataFrame([(f"{i}\t{r}\t{','.join(t)}",) for i, r, t in lines], "value string")


def test_start_ranks_and_vertices_without_edges(spark):
    edges, vertices = S.adjacency_graph(S.parse_adjacency_tsv(tsv(spark, LINES)))
    for k in (1, 2, 9):
        want, diffs = batch_reference(LINES, k)
        res = L.rank_fixed(edges, k, vertices=vertices, start=0.0)
        assert as_dict(res.ranks) == pytest.approx(want)
        assert [r["delta_fixed"] for r in res.history.orderBy("iter").collect()] == pytest.approx(diffs, abs=1.1e-5)
    for kw in ({"salt_chunk": 1}, {"broadcast": True}, {"num_partitions": 3}):
        assert as_dict(L.rank_fixed(edges, 9, vertices=vertices, start=0.0, **kw).ranks) == pytest.approx(want)


def test_declared_vertices_only(spark):
    none = spark.createDataFrame([], "src string, dst string")
    v = spark.createDataFrame([("a", 3.0), ("b", None), ("a", 1.0), (None, 9.0)], "id string, rank double")
    state = L.initial_state(L.prepare(none, vertices=v, start=7.0))
    assert as_dict(state) == {"a": 3.0, "b": 7.0}
    res = L.rank_until(none, vertices=v)
    assert as_dict(res.ranks) == {"a": 0.15, "b": 0.15} and res.status == "converged"


def _ranks(spark, path):
    return {r["value"].split("\t")[0]: float(r["value"].split("\t")[1]) for r in spark.read.text(str(path)).collect()}


def test_cli_keeps_vertices_and_ranks_of_adjacency_files(spark, tmp_path, capsys):
    f = tmp_path / "adj.tsv"
    f.write_text("1\t5.0\t2\n2\t1.0\t3\n3\t1.0\n9\t1.0\n")
    assert main(["rank", str(f), str(tmp_path / "one"), "--format", "tsv", "--max-iter", "1"]) == 0
    assert _ranks(spark, tmp_path / "one") == pytest.approx({"1": 0.15, "2": 4.4, "3": 1.0, "9": 0.15})
    j = tmp_path / "v.json"
    j.write_text("[1,5.0,[[2,0]]]\n[2,1.0,[[3,0]]]\n[9,1.0,[]]\n")
    assert main(["rank", str(j), str(tmp_path / "two"), "--format", "json", "--max-iter", "1"]) == 0
    assert _ranks(spark, tmp_path / "two") == pytest.approx({"1": 0.15, "2": 1.0, "3": 1.0, "9": 0.15})


def test_cli_counts_rejected_lines(spark, tmp_path, capsys):
    f = tmp_path / "adj.tsv"
    f.write_text("1\t5.0\t2\n2\tx\t1\nalone\n")
    assert main(["rank", str(f), str(tmp_path / "a"), "--format", "tsv"]) == 0
    err = capsys.readouterr().err
    assert "Rejected lines: 1 (rank is not a number)" in err and "Rejected lines: 1 (too few fields)" in err
    assert main(["rank", str(f), str(tmp_path / "b"), "--format", "tsv", "--strict"]) == 1
    assert not (tmp_path / "b").exists()


def test_reject_reasons(spark):
    def got(fmt, *lines):
        df = spark.createDataFrame([(x,) for x in lines], "value string")
        return {r["value"]: r["reason"] for r in S.rejects(df, fmt).collect()}
    assert got("edges", "# c", "1 2", "1", "", " # a") == {"1": S.TOO_FEW, "": S.TOO_FEW}
    assert got("tsv", "1\t1.0", "1\t1e3\t2", "1", "1\t\t2", "1\tNaNa\t2") == {
        "1": S.TOO_FEW, "1\t\t2": S.BAD_RANK, "1\tNaNa\t2": S.BAD_RANK}
    assert got("json", "[1,1.0,[]]", "[1,1.0,[[2,0.5]]]", "[1,1.0]", "x", "[1.5e,1,[]]", '["q",1,[]]',
               "[1,[],[]]", "[1,1,[[2]]]", "[1,1,[3]]", "[1,1,7]") == {
        "[1,1.0]": S.TOO_FEW, "x": S.TOO_FEW, "[1.5e,1,[]]": S.TOO_FEW, '["q",1,[]]': S.BAD_ID,
        "[1,[],[]]": S.BAD_VALUE, "[1,1,[[2]]]": S.BAD_EDGE, "[1,1,[3]]": S.BAD_EDGE, "[1,1,7]": S.BAD_EDGE}


# ------------------------------------------------------------- order-free sums

def test_exact_sum_is_close_to_the_true_sum_and_free_of_order(spark):
    rng = random.Random(1)
    xs = [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-8, 9) for _ in range(3000)]
    true = float(sum(map(Fraction, xs)))
    seen = set()
    for seed in range(3):
        rng.shuffle(xs)
        for parts in (1, 7):
            df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(parts)
            seen.add(df.agg(exact_sum("x")).first()[0])
    assert len(seen) == 1 and math.isclose(seen.pop(), true, rel_tol=1e-15)


def test_exact_sum_of_odd_values(spark):
    def total(*xs):
        return spark.createDataFrame([(x,) for x in xs], "x double").agg(exact_sum("x")).first()[0]
    assert total(None, None) is None and total(1.5, None) == 1.5
    assert total(1e300, 1.0) == 1e300 and total(float("inf"), 1.0) == math.inf
    assert math.isnan(total(float("nan"), 1.0)) and total(-0.75, 0.25) == -0.5


def hot_graph(seed=2, n=300, m=3000):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return edges + [(0, rng.randrange(n)) for _ in range(m // 2)] + [(rng.randrange(n), 1) for _ in range(m // 2)]


def test_results_do_not_depend_on_partitions_or_row_order(spark):
    edges = hot_graph()
    seen = []
    for parts, kw in ((4, {}), (8, {}), (64, {}), (8, {"salt_chunk": 20})):
        random.Random(parts).shuffle(edges)
        df = spark.createDataFrame(edges, "src long, dst long").repartition(parts)
        res = L.rank_until(df, num_partitions=parts, **kw)
        seen.append((as_dict(res.ranks), res.status, res.iterations, res.final_delta,
                     [tuple(r) for r in res.history.orderBy("iter").collect()]))
    assert all(s == seen[0] for s in seen)


# ------------------------------------------------------------- vertex programs

def frame(spark, edges, kind="src long, dst long"):
    return spark.createDataFrame(edges, kind)


@pytest.mark.parametrize("salt_chunk", [50_000, 5])
def test_vertices_halt_by_the_aggregate_of_the_superstep_before(spark, salt_chunk):
    df = frame(spark, hot_graph(3, 60, 400))
    res = vertex_program(
        df, init={"rank": F.lit(1.0)}, send=F.col("rank") / F.col("outdeg"),
        update={"rank": F.lit(0.15) + F.lit(0.85) * F.coalesce("msg", F.lit(0.0))},
        aggregators={"diff": exact_sum(F.abs(F.col("rank") - F.col("old_rank")))},
        vote_to_halt=(F.col("superstep") > 1) & (F.col("agg_diff") < 1e-4), salt_chunk=salt_chunk)
    want = L.rank_until(df, lag=1)
    assert as_dict(res.vertices) == as_dict(want.ranks)
    assert res.halted_by == "inactive" and res.supersteps == want.iterations


def test_aggregates_reach_update_and_send(spark):
    # every vertex adds the number of vertices counted in the superstep before
    df = frame(spark, [(1, 2), (2, 3), (3, 1)])
    res = vertex_program(
        df, init={"x": F.lit(0.0), "got": F.lit(0.0)}, send=F.col("agg_n"),
        update={"x": F.col("x") + F.col("agg_n"), "got": F.col("got") + F.coalesce("msg", F.lit(0.0))},
        aggregators={"n": F.count(F.lit(1)).cast("double")}, max_supersteps=4)
    assert as_dict(res.vertices, "x", "got") == dict.fromkeys((1, 2, 3), (9.0, 9.0))


def hops(edges, root):
    far, parent, front, d = {root: 0}, {}, {root}, 0
    while front:
        d += 1
        near = {}
        for s, t in edges:
            if s in front and t not in far:
                near[t] = min(s, near.get(t, s))
        far.update(dict.fromkeys(near, d))
        parent.update(near)
        front = set(near)
    ids = {x for e in edges for x in e}
    return {i: (far.get(i), parent.get(i)) for i in ids}


@pytest.mark.parametrize("salt_chunk", [50_000, 3])
def test_messages_of_two_fields(spark, salt_chunk):
    edges = hot_graph(4, 200, 300)
    res = vertex_program(
        frame(spark, edges),
        init={"hops": F.when(F.col("id") == 7, 0).cast("bigint"), "parent": F.lit(None).cast("bigint")},
        send={"hops": F.col("hops") + 1, "parent": F.col("id")},
        combine={"best": F.min(F.when(F.col("hops").isNotNull(), F.struct("hops", "parent")))},
        update={"hops": F.coalesce("hops", "best.hops"),
                "parent": F.when(F.col("hops").isNull(), F.col("best.parent")).otherwise(F.col("parent"))},
        vote_to_halt=F.col("old_hops").isNotNull() | F.col("hops").isNull(), salt_chunk=salt_chunk)
    assert as_dict(res.vertices, "hops", "parent") == hops(edges, 7)
    assert res.halted_by == "inactive"


def labels(edges, rounds):
    lab = {x: x for e in edges for x in e}
    for _ in range(rounds):
        votes = {}
        for s, t in edges:
            votes.setdefault(t, {}).setdefault(lab[s], 0)
            votes[t][lab[s]] += 1
        lab = {i: min(votes[i], key=lambda x: (-votes[i][x], x)) if i in votes else x for i, x in lab.items()}
    return lab


@pytest.mark.parametrize("salt_chunk", [50_000, 5])
def test_most_frequent_label(spark, salt_chunk):
    edges = hot_graph(5, 40, 500)
    edges += edges[:200]      # parallel edges count as often as they are
    res = vertex_program(
        frame(spark, edges), init={"label": F.col("id")}, send={"label": F.col("label")},
        combine={"best": F.max(F.struct("mult", (-F.col("label")).alias("minus")))}, count_equal=True,
        update={"label": F.coalesce(-F.col("best.minus"), F.col("label"))}, max_supersteps=3,
        salt_chunk=salt_chunk)
    assert as_dict(res.vertices, "label") == labels(edges, 3)


@pytest.mark.parametrize("salt_chunk", [50_000, 4])
def test_edge_values(spark, salt_chunk):
    # parallel edges of different weight are edges of their own; shortest ways
    rng = random.Random(6)
    edges = [(s, t, rng.randrange(1, 9)) for s, t in hot_graph(6, 80, 300)]
    res = vertex_program(
        frame(spark, edges, "src long, dst long, w long"), values=("w",),
        init={"far": F.when(F.col("id") == 0, 0).cast("bigint")},
        send=F.col("far"), along={"m": F.col("m") + F.col("w")}, combine="min",
        update={"far": F.least("far", "msg")},
        vote_to_halt=F.col("far").eqNullSafe(F.col("old_far")), salt_chunk=salt_chunk)
    far = {x: math.inf for e in edges for x in e[:2]}
    far[0] = 0
    for _ in far:
        for s, t, w in edges:
            far[t] = min(far[t], far[s] + w)
    assert as_dict(res.vertices, "far") == {k: None if v == math.inf else v for k, v in far.items()}


def test_combine_must_fit_the_message(spark):
    df = frame(spark, [(1, 2)])
    kw = {"init": {"x": F.lit(0.0)}, "update": {"x": F.col("x")}, "max_supersteps": 1}
    with pytest.raises(ValueError):
        vertex_program(df, send={"a": F.col("x"), "b": F.col("x")}, **kw)
    with pytest.raises(ValueError):
        vertex_program(df, send=F.col("x"), combine="median", **kw)


# ------------------------------------------------------------------ snapshots

def test_markers_are_read_once_a_run(spark, tmp_path, monkeypatch):
    reads = []
    own = L._list_snapshots
    monkeypatch.setattr(L, "_list_snapshots", lambda *a: reads.append(1) or own(*a))
    g = L.prepare(frame(spark, hot_graph(7, 30, 100)))
    base = str(tmp_path / "s")
    first = L.run(g, tol=None, max_iter=6, snapshot_dir=base)
    assert len(reads) == 1
    again = L.run(g, tol=None, max_iter=9, snapshot_dir=base, resume=True)
    assert len(reads) == 2 and again.iterations == 9
    assert [tuple(r) for r in again.history.orderBy("iter").collect()][:6] == \
        [tuple(r) for r in first.history.orderBy("iter").collect()]
