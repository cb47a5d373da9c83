"""Sinks round-trip through files; telemetry plans stay JVM-side."""

import pytest
from pyspark.sql import functions as F

from rankflow.operators import benchstats as BS
from rankflow.operators import telemetry as TM
from rankflow.plans import loop as L
from rankflow.sinks import append_metrics, write_adjacency_tsv, write_ranks
from rankflow.sources.text import parse_adjacency_tsv, read_lines


def test_rank_text_and_snapshot_round_trip(spark, tmp_path, golden_edges):
    res = L.rank_until(golden_edges)
    write_ranks(res.ranks, str(tmp_path / "ranks"))
    back = {}
    for r in read_lines(spark, str(tmp_path / "ranks")).collect():
        k, v = r["value"].split("\t")
        back[k] = float(v)
    assert back == {r["id"]: r["rank"] for r in res.ranks.collect()}
    L.write_snapshot(res.state, str(tmp_path / "snap"), 26, [(26, 0.5, 0.25)])
    with pytest.raises(Exception):
        L.write_snapshot(res.state, str(tmp_path / "snap"), 26, [(26, 0.5, 0.25)])   # never overwrite
    snap = L.read_snapshot(spark, str(tmp_path / "snap"), 26)
    assert snap.count() == 5 and set(snap.columns) >= {"id", "rank", "prev"}


def test_adjacency_file_round_trip(spark, tmp_path, golden_edges):
    from rankflow.operators import graph as G
    adj = G.adjacency(golden_edges)
    write_adjacency_tsv(adj, str(tmp_path / "adj"))
    back = parse_adjacency_tsv(read_lines(spark, str(tmp_path / "adj")))
    got = {r["id"]: sorted(r["nbrs"]) for r in back.collect()}
    assert got == {r["id"]: sorted(r["nbrs"]) for r in adj.collect()}


def test_metrics_append_and_read(spark, tmp_path):
    m = spark.createDataFrame(
        [("a", "small", "a_1", 10.0, 0.5, 1.0, 2.0, 20, 0.0, 10.0)],
        "algorithm string, dataset string, job_id string, total_execution_time double, "
        "avg_iteration_time double, network_communication double, peak_memory_usage double, "
        "iterations_to_converge int, final_diff double, cpu_utilization double")
    path = str(tmp_path / "metrics")
    append_metrics(m, path)
    append_metrics(m.withColumn("job_id", F.lit("a_2")), path)
    raw = BS.read_metrics_csv(spark, path)
    assert sorted(r["job_id"] for r in raw.collect()) == ["a_1", "a_2"]


def test_telemetry_plan_is_jvm_only(spark):
    from conftest import lines_df
    from rankflow.sources.logs import parse_job_log, parse_sar
    logs = parse_job_log(lines_df(spark, ["Final Diff: 1E-4"], "j"))
    s = parse_sar(lines_df(spark, ["12:00:02 AM all 1.00 0.00 2.00 0.00 0.00 97.00"], "j"))
    runs = spark.createDataFrame([("j", "giraph", "small", 1.0)],
                                 "job_id string, algorithm string, dataset string, total_time double")
    plan = TM.job_metrics(logs, s, runs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    # per-job aggregates are combined map-side before their shuffle (a job
    # with a huge log never lands whole in one task)
    assert "partial_max_by" in plan and "partial_avg" in plan
