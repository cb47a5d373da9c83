"""Link-rank update, loop semantics and plan shape (FIXTURES section 2)."""

import random

import pytest
from pyspark.sql import functions as F

from rankflow.operators import graph as G
from rankflow.operators import rank as R
from rankflow.operators.vertex_program import link_rank_program
from rankflow.plans import loop as L

UPDATE1 = {"1": 0.433333333, "2": 0.716666667, "3": 2.416666667, "4": 0.15, "6": 0.433333333}
UPDATE2 = {"1": 0.834722222, "2": 0.395555556, "3": 1.694166667, "4": 0.15, "6": 0.834722222}
STOP26 = {"1": 0.444606, "2": 0.401951, "3": 1.039750, "4": 0.15, "6": 0.444606}
LAG27 = {"1": 0.444596, "2": 0.401943, "3": 1.039726, "4": 0.15, "6": 0.444596}


def as_dict(df, col="rank"):
    return {r["id"]: r[col] for r in df.collect()}


def close(a, b, tol=1e-6):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) <= tol for k in a)


def brute_force(edges, updates=None, tol=1e-4, kind="l1", lag=0, max_iter=500):
    """Plain-Python reference of the loop (small inputs only)."""
    ids = sorted({x for e in edges for x in e})
    out = {}
    for s, _ in edges:
        out[s] = out.get(s, 0) + 1
    r = {i: 1.0 for i in ids}
    k, hist, status = 0, [], "max_iterations"
    min_up = 1 if kind == "l1" else 2

    def upd(r):
        acc = {i: 0.0 for i in ids}
        for s, d in edges:
            acc[d] += r[s] / out[s]
        return {i: 0.15 + 0.85 * acc[i] for i in ids}
    while k < (updates or max_iter):
        n = upd(r)
        d = sum(abs(n[i] - r[i]) for i in ids)
        f = sum(int(abs(n[i] - r[i]) * 100000) for i in ids) / 100000.0
        k += 1
        r = n
        hist.append((d, f))
        t = d if kind == "l1" else f
        if updates is None and k >= min_up and t < tol:
            status = "converged"
            break
    if lag and status == "converged":
        r = upd(r)
        k += 1
    return r, k, status, hist


def test_one_update_golden(golden_edges):
    step = R.rank_step(golden_edges, G.init_ranks(G.vertices(golden_edges)))
    assert close(as_dict(step), UPDATE1, 1e-9)
    assert R.l1_delta(step) == pytest.approx(3.683333333, abs=1e-8)
    assert R.fixed_point_delta(step) == pytest.approx(3.68331, abs=1e-12)
    step2 = R.rank_step(golden_edges, step.select("id", "rank"))
    assert close(as_dict(step2), UPDATE2, 1e-9)
    assert R.l1_delta(step2) == pytest.approx(1.846388889, abs=1e-8)
    # vertex 3 changes by 289/400, which lies on the edge of a unit of 1e-5:
    # the last binary place of its two ranks decides whether 72250 or 72249 count
    assert R.fixed_point_delta(step2) == pytest.approx(1.84637, abs=1.1e-5)


@pytest.mark.parametrize("kind", ["l1", "fixed_point"])
def test_rank_until_golden(golden_edges, kind):
    res = L.rank_until(golden_edges, delta=kind)
    assert res.status == "converged" and res.iterations == 26
    assert close(as_dict(res.ranks), STOP26, 1e-6)
    want = 7.479943e-05 if kind == "l1" else 6e-05
    assert res.final_delta == pytest.approx(want, abs=1e-10)
    hist = res.history.orderBy("iter").collect()
    assert [h["iter"] for h in hist] == list(range(1, 27))
    assert hist[0]["delta_fixed"] == pytest.approx(3.68331, abs=1e-12)


def test_lag1_golden(golden_edges):
    res = L.rank_until(golden_edges, lag=1)
    assert res.iterations == 27 and close(as_dict(res.ranks), LAG27, 1e-6)


def test_cap_is_not_an_error(golden_edges):
    res = L.rank_until(golden_edges, max_iter=5)
    assert (res.status, res.iterations) == ("max_iterations", 5)
    assert res.history.count() == 5


def test_pure_cycle_first_tested_delta(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert L.rank_until(e).iterations == 1
    assert L.rank_until(e, lag=1).iterations == 2
    assert L.rank_until(e, delta="fixed_point").iterations == 2


def test_self_loop_star_and_empty(spark):
    loop = spark.createDataFrame([("x", "x")], "src string, dst string")
    assert as_dict(L.rank_until(loop).ranks) == {"x": 1.0}
    star = spark.createDataFrame([(f"l{i}", "hub") for i in range(5)], "src string, dst string")
    r = as_dict(L.rank_until(star).ranks)
    assert r["hub"] == pytest.approx(0.15 + 0.85 * 5 * 0.15) and r["l0"] == pytest.approx(0.15)
    empty = spark.createDataFrame([], "src string, dst string")
    res = L.rank_until(empty)
    assert res.ranks.count() == 0 and res.status == "converged"


def _random_edges(seed, n=12, m=40):
    rnd = random.Random(seed)
    return [(f"v{rnd.randrange(n)}", f"v{rnd.randrange(n)}") for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_loop_variants_equal_brute_force(spark, seed):
    edges = _random_edges(seed)
    df = spark.createDataFrame(edges, "src string, dst string")
    want, k, status, _ = brute_force(edges)
    for kw in ({}, {"broadcast": True}, {"salt_chunk": 1}, {"num_partitions": 3}):
        res = L.rank_until(df, **kw)
        assert (res.iterations, res.status) == (k, status), kw
        assert close(as_dict(res.ranks), want, 1e-9), kw
    vp = link_rank_program(df)
    assert close(as_dict(vp.vertices), want, 1e-9)
    wantf, kf, _, _ = brute_force(edges, kind="fixed_point")
    resf = L.rank_until(df, delta="fixed_point")
    assert resf.iterations == kf and close(as_dict(resf.ranks), wantf, 1e-9)


def test_tagged_union_equals_rank_step(spark):
    edges = _random_edges(7, n=30, m=120)
    df = spark.createDataFrame(edges, "src string, dst string")
    want, _, _, _ = brute_force(edges, updates=6)
    got = as_dict(L.rank_tagged_fixed(df, 6))
    assert close(as_dict(L.rank_tagged_fixed(df, 6, salt_chunk=2)), want, 1e-9)
    assert close(got, want, 1e-9)
    assert close(as_dict(L.rank_fixed(df, 6).ranks), want, 1e-9)


def test_rank_properties(spark):
    edges = _random_edges(11, n=40, m=200)
    df = spark.createDataFrame(edges, "src string, dst string")
    res = L.rank_until(df)
    ranks = as_dict(res.ranks)
    assert min(ranks.values()) >= 0.15 - 1e-12
    assert sum(ranks.values()) <= len(ranks) + 1e-9
    # permutation of the input rows changes nothing
    shuffled = spark.createDataFrame(list(reversed(edges)), "src string, dst string")
    assert close(as_dict(L.rank_until(shuffled).ranks), ranks, 1e-9)
    # the fixed-point rule stops no later than the l1 rule
    assert L.rank_until(df, delta="fixed_point").iterations <= res.iterations + 1


def test_resume_equals_uninterrupted(spark, tmp_path, golden_edges):
    g = L.prepare(golden_edges)
    base = str(tmp_path / "snap")
    L.run(g, max_iter=7, checkpoint_every=3, snapshot_dir=base)
    res = L.run(g, checkpoint_every=3, snapshot_dir=base, resume=True)
    assert res.iterations == 26 and close(as_dict(res.ranks), STOP26, 1e-6)


def test_update_plan_has_one_exchange_and_no_python(spark, golden_edges):
    for parts, want in ((4, 1), (1, 0)):    # one partition needs no exchange
        g = L.prepare(golden_edges, num_partitions=parts)
        after_two = L.run(g, tol=None, max_iter=2).state      # a checkpointed loop state
        with L._LoopConf(spark, g.num_partitions, False):
            for st in (L.initial_state(g).checkpoint(eager=True), after_two):
                plan = L.step(g, st)._jdf.queryExecution().executedPlan().toString()
                # one shuffle per update: the partial vote sums (the cached
                # edges were partitioned once, in prepare; the state keeps
                # its layout)
                assert plan.count("ENSURE_REQUIREMENTS") == want, plan
                assert "Python" not in plan and "BatchEval" not in plan


def test_hot_source_is_salted_and_spread(spark):
    # one hub sends to 400 targets (plus parallel edges), a few ordinary edges
    edges = [("hub", f"t{i}") for i in range(400)] + [("hub", "t1"), ("hub", "t1")]
    edges += [(f"t{i}", "hub") for i in range(0, 400, 7)] + [("t3", "t4"), ("t4", "t3")]
    df = spark.createDataFrame(edges, "src string, dst string")
    g = L.prepare(df, salt_chunk=50, num_partitions=6)
    assert g.num_hot == 1 and g.hot_edges is not None
    per_part = (g.hot_edges.groupBy(F.spark_partition_id().alias("p")).count()
                .agg(F.count(F.lit(1)).alias("parts"), F.max("count").alias("mx")).first())
    assert per_part["parts"] >= 4 and per_part["mx"] <= 150   # 8 buckets of ~50 targets
    want, k, status, _ = brute_force(edges)
    res = L.run(g)
    assert (res.iterations, res.status) == (k, status)
    assert close(as_dict(res.ranks), want, 1e-9)


def test_vertex_program_min_combiner_and_vote_to_halt(spark):
    from rankflow.operators.vertex_program import vertex_program
    edges = _random_edges(5, n=25, m=30)
    edges = edges + [(d, s) for s, d in edges]           # both directions
    df = spark.createDataFrame(edges, "src string, dst string")
    res = vertex_program(
        df,
        init={"label": F.col("id")},
        send=F.col("label"),
        update={"label": F.least(F.col("label"), F.coalesce("msg", F.col("label")))},
        combine="min",
        vote_to_halt=F.col("label") == F.col("old_label"),
        aggregators={"changed": F.sum((F.col("label") != F.col("old_label")).cast("double"))})
    # plain Python: smallest id reachable = component minimum
    ids = sorted({x for e in edges for x in e})
    lab = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for s, d in edges:
            if lab[s] < lab[d]:
                lab[d], changed = lab[s], True
    assert as_dict(res.vertices, "label") == lab
    assert res.halted_by == "inactive"


def test_lost_cached_blocks_are_recomputed(spark, tmp_path, golden_edges):
    # the persisted copies vanish mid-run (as with a lost executor); the
    # resumed run recomputes them from the checkpointed multiset
    g = L.prepare(golden_edges, num_partitions=3)
    base = str(tmp_path / "snap")
    L.run(g, max_iter=9, checkpoint_every=1, snapshot_dir=base)
    g.release()
    res = L.run(g, checkpoint_every=1, snapshot_dir=base, resume=True)
    assert res.iterations == 26 and close(as_dict(res.ranks), STOP26, 1e-6)


def test_vertex_program_from_vertex_json(spark):
    # S3 input: per-vertex value and edges; vertex 9 has no edges at all
    from rankflow.operators.vertex_program import vertex_program
    from rankflow.sources.text import parse_vertex_json
    lines = ["[1,1.0,[[2,0],[2,0],[3,0]]]", "[2,1.0,[[3,0]]]", "[3,1.0,[[1,0],[3,0],[6,0]]]",
             "[4,1.0,[[3,0]]]", "[6,1.0,[]]", "[9,5.0,[]]"]
    vj = parse_vertex_json(spark.createDataFrame([(x,) for x in lines], "value string"))
    edges = vj.select(F.col("id").alias("src"), F.explode("edges").alias("e")).select(
        "src", F.col("e.dst").alias("dst"))
    res = vertex_program(
        edges, vertices=vj.select("id", F.col("value").alias("v0")),
        init={"rank": F.coalesce("v0", F.lit(1.0))},
        send=F.col("rank") / F.col("outdeg"),
        update={"rank": F.lit(0.15) + F.lit(0.85) * F.coalesce("msg", F.lit(0.0))},
        aggregators={"sum_diff": F.sum(F.abs(F.col("rank") - F.col("old_rank")))},
        halt=lambda s, agg: s > 1 and agg["sum_diff"] < 1e-4)
    got = {str(k): v for k, v in as_dict(res.vertices).items()}
    assert close({k: got[k] for k in STOP26}, STOP26, 1e-6)
    assert got["9"] == pytest.approx(0.15)


def test_null_ends_are_ignored(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), (None, "a"), ("b", None)],
                               "src string, dst string")
    clean = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert as_dict(L.rank_until(df).ranks) == as_dict(L.rank_until(clean).ranks)


def test_partition_count_bounds():
    class Conf:
        def __init__(self, n):
            self.n = n

        def get(self, key, default=None):
            return str(self.n)

    class Session:
        def __init__(self, cap, par):
            self.conf = Conf(cap)
            self.sparkContext = type("SC", (), {"defaultParallelism": par})()

    assert L.choose_partitions(Session(8, 8), 0) == 1
    assert L.choose_partitions(Session(8, 8), 45_257) == 5           # >= 10 k edges each
    assert L.choose_partitions(Session(8, 8), 452_764) == 8          # the parallelism
    assert L.choose_partitions(Session(200, 4000), 10**7) == 1000    # >= 10 k edges each
    assert L.choose_partitions(Session(200, 8), 10**12) == 10**6     # no cap: 1 M edges each


def test_tagging_a_source_with_a_third_of_all_edges_is_even(spark):
    """No task of the tagging join reads more than twice the mean."""
    n = 60_000
    mult = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000 + 100).alias("src"),
        F.col("id").alias("dst"), F.lit(1).cast("bigint").alias("mult"))
    hot = R.hot_sources(mult.groupBy("src").agg(F.count(F.lit(1)).alias("fanout")), 1000)
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                            "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        tagged = R.tag_salts(mult, hot)
        rows = [r["count"] for r in tagged.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(rows) == n and max(rows) <= 2 * n / 8, rows
        salts = {r["salt"]: r["count"] for r in tagged.where("src = 7").groupBy("salt").count().collect()}
        assert len(salts) == 20 and max(salts.values()) <= 1500
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_one_step_form_with_salts(spark):
    edges = [("hub", f"t{i}") for i in range(90)] + [("hub", "t1")] * 5 + [("t1", "hub"), ("t2", "t2")]
    df = spark.createDataFrame(edges, "src string, dst string")
    ranks = G.init_ranks(G.vertices(df))
    want, _, _, _ = brute_force(edges, updates=1)
    for chunk in (7, 50_000):
        assert close(as_dict(R.rank_step(df, ranks, salt_chunk=chunk)), want, 1e-12)
        votes = R.contributions(df, ranks, salt_chunk=chunk)
        assert votes.count() == len(edges)
        assert votes.where("dst = 't1'").count() == 6


def test_resume_after_a_break(spark, tmp_path, golden_edges):
    g = L.prepare(golden_edges)
    whole = L.run(g, max_iter=7)
    base = str(tmp_path / "snap")
    L.run(g, max_iter=4, checkpoint_every=2, snapshot_dir=base)
    # a run that broke off between snapshot and marker
    whole.state.write.parquet(f"{base}/iter=6")
    res = L.run(g, max_iter=7, checkpoint_every=2, snapshot_dir=base, resume=True)
    hist = lambda r: [tuple(x) for x in r.history.orderBy("iter").collect()]
    assert [h[0] for h in hist(res)] == list(range(1, 8))
    assert [h[1] for h in hist(res)] == pytest.approx([h[1] for h in hist(whole)])
    assert close(as_dict(res.ranks), as_dict(whole.ranks), 1e-12)
    # resuming at the cap keeps the history and the last delta
    again = L.run(g, max_iter=6, checkpoint_every=2, snapshot_dir=base, resume=True)
    assert again.iterations == 6 and again.final_delta == pytest.approx(hist(whole)[5][1])
    assert [h[0] for h in hist(again)] == list(range(1, 7))


def test_resumed_update_plan_has_one_exchange(spark, tmp_path, golden_edges):
    g = L.prepare(golden_edges, num_partitions=4)
    base = str(tmp_path / "snap")
    L.run(g, tol=None, max_iter=2, snapshot_dir=base)
    state = L.run(g, tol=None, max_iter=4, snapshot_dir=base, resume=True).state
    with L._LoopConf(spark, g.num_partitions, False):
        plan = L.step(g, state)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") == 1, plan


def test_broadcast_is_refused_above_the_limit(spark, golden_edges):
    assert L._bytes_conf(spark, "rankflow.none", 7) == 7
    spark.conf.set("rankflow.test.bytes", "10MB")
    assert L._bytes_conf(spark, "rankflow.test.bytes", 0) == 10 << 20
    spark.conf.unset("rankflow.test.bytes")
    assert L.prepare(golden_edges, broadcast=True, broadcast_bytes=10).broadcast is False
    g = L.prepare(golden_edges, broadcast=True, broadcast_bytes=10 << 20)
    assert g.broadcast is True
    assert close(as_dict(L.run(g).ranks), STOP26, 1e-6)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_packed_votes_give_the_same_ranks(spark, kind):
    e = spark.range(3000).select((F.col("id") * 7 % 97).cast(kind).alias("src"),
                                 (F.col("id") * 31 % 389 + F.col("id") % 2).cast(kind).alias("dst"))
    v = spark.range(400).select(F.col("id").cast(kind).alias("id"), (F.col("id") % 5 / 3).alias("rank"))
    plain = L.rank_until(e, vertices=v, num_partitions=3)
    for parts in (1, 4):
        got = L.rank_until(e, vertices=v, num_partitions=parts, packed=True)
        assert (got.iterations, got.final_delta) == (plain.iterations, plain.final_delta)
        assert sorted(map(tuple, got.ranks.collect())) == sorted(map(tuple, plain.ranks.collect()))
    g = L.prepare(e, num_partitions=2, packed=True)
    assert g.slots is not None and L.prepare(e, packed=None).slots is None
    assert L.prepare(e, packed=True, salt_chunk=5).slots is None      # hot sources keep their salted join
    g.release()


def test_votes_of_a_hot_target_are_combined_before_they_move(spark, monkeypatch):
    """Without one they move as single numbers; the sums are the same."""
    e = spark.range(2000).select((F.col("id") % 50).alias("src"), F.when(F.col("id") % 3 == 0, 7).otherwise(
        F.col("id") % 211).cast("bigint").alias("dst"))
    plans, ranks = [], []
    monkeypatch.setattr(L, "SINGLE_EDGE_ROWS", 1)
    for chunk in (R.SALT_CHUNK, 20):
        monkeypatch.setattr(L, "SALT_CHUNK", chunk)
        g = L.prepare(e, num_partitions=3, salt_chunk=R.SALT_CHUNK)
        with L._LoopConf(spark, g.num_partitions, False):
            new = L.step(g, L.initial_state(g))
            plans.append(new._jdf.queryExecution().executedPlan().toString())
            ranks.append(sorted(map(tuple, new.select("id", "rank").collect())))
        assert g.single_votes == (chunk != 20)
        g.release()
    # the layout of the edges is one in both
    assert [p.count("REPARTITION_BY_NUM") for p in plans] == [2, 1]
    assert ranks[0] == ranks[1]


def test_tagging_many_hot_sources_broadcasts_nothing(spark):
    mult = spark.range(9000).select((F.col("id") % 1000).alias("src"), F.col("id").alias("dst"),
                                    F.lit(1).cast("bigint").alias("mult"))
    hot = R.hot_sources(mult.where("src % 2 = 0").groupBy("src").agg(F.count(F.lit(1)).alias("fanout")), 2).persist()
    assert hot.count() == 500
    tagged = R.tag_salts(mult, hot, salt_chunk=2)
    assert "Broadcast" not in tagged._jdf.queryExecution().executedPlan().toString()
    rows = tagged.collect()
    assert sorted(r.dst for r in rows) == list(range(9000))
    assert all((r.nsalt == 5 and 0 <= r.salt < 5) if r.src % 2 == 0 else (r.nsalt, r.salt) == (1, 0) for r in rows)
    plain = {tuple(r) for r in R.tag_salts(mult, hot).collect()}
    assert plain == {tuple(r) for r in rows}
    hot.unpersist()
