"""Job-log and monitor-log metrics on FIXTURES sections 4 and 5."""

import pytest

from conftest import lines_df
from rankflow.operators import telemetry as TM
from rankflow.sinks import format_metrics
from rankflow.sources.logs import parse_job_log, parse_sar

BSP_LOG = [
    "INFO job: start",
    "finishSuperstep: Superstep -1 done",
    "finishSuperstep: 0",
    "Superstep=12 completed, Total Diff: 0.5",
    "superstep 7 finished",
    "Total Diff: 2.5E-4",
    "Global Diff: 77",
]
BATCH_LOG = [
    "Job job_1 completed successfully",
    "Iteration 0 Diff: 12.5",
    "Job job_2 completed successfully",
    "Iteration 1 Diff: 8.0E-5",
    "Final Diff: 8.0E-5",
    "Iteration 9 Diff: 99",
]

SAR_12H = """Linux 5.4.0 (host) \t01/02/2025 \t_x86_64_\t(4 CPU)

12:00:01 AM     CPU     %user     %nice   %system   %iowait    %steal     %idle
12:00:02 AM     all     10.00      0.00      2.00      0.50      0.00     87.50

12:00:01 AM kbmemfree   kbavail kbmemused  %memused kbbuffers  kbcached  kbcommit   %commit  kbactive   kbinact   kbdirty
12:00:02 AM   6000000   6500000   2097152     25.00      1000    500000   3000000     30.00   1000000    200000       100

12:00:01 AM     IFACE   rxpck/s   txpck/s    rxkB/s    txkB/s   rxcmp/s   txcmp/s  rxmcst/s   %ifutil
12:00:02 AM        lo     99.00     99.00   5000.00   5000.00      0.00      0.00      0.00      0.00
12:00:02 AM      eth0     10.00      5.00    100.00     50.00      0.00      0.00      0.00      0.00

12:00:02 AM     CPU     %user     %nice   %system   %iowait    %steal     %idle
12:00:03 AM     all     30.00      0.00      6.00      1.50      0.00     62.50

12:00:02 AM kbmemfree   kbavail kbmemused  %memused kbbuffers  kbcached  kbcommit   %commit  kbactive   kbinact   kbdirty
12:00:03 AM   5000000   5500000   3145728     37.50      1200    500000   3000000     30.00   1000000    200000       100

12:00:02 AM     IFACE   rxpck/s   txpck/s    rxkB/s    txkB/s   rxcmp/s   txcmp/s  rxmcst/s   %ifutil
12:00:03 AM      eth0     30.00     15.00    300.00    150.00      0.00      0.00      0.00      0.00
""".splitlines()


def _runs(spark, job, algo, seconds):
    return spark.createDataFrame([(job, algo, "small", float(seconds))],
                                 "job_id string, algorithm string, dataset string, total_time double")


def _one(df, col):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][col]


def test_bsp_log(spark):
    p = parse_job_log(lines_df(spark, BSP_LOG, "bsp_small_1", "giraph"))
    assert _one(TM.iterations(p), "iterations_to_converge") == 12
    assert _one(TM.final_diff(p), "final_diff") == pytest.approx(0.00025)


def test_batch_log_and_fallbacks(spark):
    p = parse_job_log(lines_df(spark, BATCH_LOG, "batch_small_1", "mapreduce"))
    assert _one(TM.iterations(p), "iterations_to_converge") == 2
    assert _one(TM.final_diff(p), "final_diff") == pytest.approx(0.00008)
    no_final = [x for x in BATCH_LOG if not x.startswith("Final")]
    p2 = parse_job_log(lines_df(spark, no_final, "b", "mapreduce"))
    assert _one(TM.final_diff(p2), "final_diff") == pytest.approx(99.0)
    empty = lines_df(spark, [""], "e", "mapreduce")
    m = TM.log_summary(parse_job_log(empty)).collect()[0]
    assert (m["iterations_to_converge"], m["final_diff"]) == (1, 0.0)


def test_monitor_12h_and_24h(spark):
    runs = _runs(spark, "j", "giraph", 20)
    for lines in (SAR_12H, [x.replace(" AM", "") for x in SAR_12H]):
        s = parse_sar(lines_df(spark, lines))
        assert _one(TM.cpu_util(s), "cpu_utilization") == pytest.approx(24.0)
        assert _one(TM.peak_mem_gb(s), "peak_memory_usage") == pytest.approx(3.0)
        assert _one(TM.network_mb(s, runs), "network_communication") == pytest.approx(5.859375)
        assert _one(TM.network_mb_compat(s, runs), "network_communication") == pytest.approx(
            9.350586, abs=1e-6)


def test_job_metrics_and_csv_row(spark):
    logs = parse_job_log(lines_df(spark, BSP_LOG, "j", "giraph"))
    s = parse_sar(lines_df(spark, SAR_12H, "j"))
    m = TM.job_metrics(logs, s, _runs(spark, "j", "giraph", 36)).collect()[0]
    assert m["iterations_to_converge"] == 12 and m["avg_iteration_time"] == pytest.approx(3.0)
    row = format_metrics(TM.job_metrics(logs, s, _runs(spark, "j", "giraph", 36),
                                        network="as_coded")).collect()[0]["value"]
    assert row == "giraph,small,j,36.00s,3.00s,16.83MB,3.00GB,12,0.000250,24.00%"


def test_collect_metrics_rules(spark):
    lines = ["INFO Total execution time: 36 s", "Bytes sent 1048576 x", "Bytes sent 1048576 y",
             "Memory Used: 2048 MB", "Memory Used: 512 MB", "Superstep 1", "Superstep 2",
             "Reduce task SUCCEEDED", "  Map input records=1048576",
             "  Reduce input records=1048576", "Job Run time: 954000 ms"]
    df = lines_df(spark, lines)
    assert _one(TM.bytes_sent_mb(df), "bytes_sent_mb") == pytest.approx(2.0)
    assert _one(TM.max_memory_gb(df), "max_memory_gb") == pytest.approx(2.0)
    assert _one(TM.shuffle_mb_estimate(df), "shuffle_mb") == pytest.approx(200.0)
    assert _one(TM.log_value(df, "Total execution time", 5), "value") == 36.0
    assert _one(TM.log_value(df, "Run time", 4, 1000.0), "value") == 954.0
    assert _one(TM.count_lines(df, "Superstep"), "n") == 2
    assert _one(TM.count_lines(df, "Reduce", "SUCCEEDED"), "n") == 1
    rate = spark.range(1).select(TM.convergence_rate(1.0, 0.0001, 10).alias("r"))
    assert _one(rate, "r") == pytest.approx(9.999)


# one monitor line -> (cpu %, peak memory GB, as-coded network rate), worked out by hand
SAR_LINES = [
    ("12:00:01 all 1.50 0.00 0.25 0.00", (1.75, None, None)),        # user and system after "all"
    ("12:00:01 AM all 1 2 3", (4.0, None, None)),
    ("12:00:01 all 1.50 9", (None, None, None)),                     # no system column
    ("12:00:01 all x 0 0.25", (None, None, None)),                   # not a number
    ("12:00:01 10 20 3145728", (None, 3.0, None)),                   # third value, in KB
    ("12:00:01 PM 10 20 2097152 4", (None, 2.0, None)),              # a clock of two tokens
    ("12:00:01 10 20 1024", (None, None, None)),                     # not above 1024 KB
    ("12:00:01 eth0 1 2 10 20 0", (None, None, 30.0)),               # fourth and fifth value
    ("12:00:01 lo 1 2 10 20 0", (None, None, None)),                 # loopback
    ("12:00:01 CPU 1 2 10 20 0", (None, None, None)),
    ("Linux 12:00 all 1 2 3", (None, None, None)),
    ("Average: all 1 2 3", (None, None, None)),
    ("12:00:01 IFACE 1 2 10 20 0", (None, None, None)),
    ("", (None, None, None)),
]


def _monitor(spark, lines, job="j"):
    rows = [(job, "giraph", i, x) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "job_id string, algo string, pos bigint, value string")
    r = TM.monitor_summary(parse_sar(df)).collect()
    return (r[0]["cpu_utilization"], r[0]["peak_memory_usage"], r[0]["compat_rate"]) if r else (None,) * 3


def test_monitor_lines_one_by_one(spark):
    rows = [(f"j{i}", "giraph", 0, x) for i, (x, _) in enumerate(SAR_LINES)]
    df = spark.createDataFrame(rows, "job_id string, algo string, pos bigint, value string")
    got = {r["job_id"]: (r["cpu_utilization"], r["peak_memory_usage"], r["compat_rate"])
           for r in TM.monitor_summary(parse_sar(df)).collect()}
    for i, (line, want) in enumerate(SAR_LINES):
        assert got.get(f"j{i}", (None, None, None)) == pytest.approx(want), line


def test_monitor_means_and_peak(spark):
    lines = [x for x, _ in SAR_LINES]
    want = (pytest.approx((1.75 + 4) / 2), 3.0, 30.0)
    assert _monitor(spark, lines) == want
    assert _monitor(spark, lines[::-1]) == want                      # in any order
    twelve = [x.replace("12:00:01 ", "12:00:01 AM ") if "M " not in x else x for x in lines]
    assert _monitor(spark, twelve) == want                           # with either clock


# a log -> (iterations, final difference), worked out by hand
JOB_LOGS = [
    ("giraph", ["Superstep 3 finished"], (3, 0.0)),
    ("giraph", ["superstep: 7 completed", "Superstep=2 finished"], (7, 0.0)),   # the largest
    ("giraph", ["Superstep 9 started", "superstep -3 finished"], (1, 0.0)),     # at least one
    ("giraph", ["Final Diff: 1.5E-4", "Total Diff: 9"], (1, 1.5e-4)),           # final beats total
    ("giraph", ["Total Diff: 9", "Total Diff: 8"], (1, 8.0)),                   # the last counts
    ("giraph", ["Total Diff: 9", "Final Diff: n/a"], (1, 9.0)),                 # no number, no change
    ("giraph", ["Final Diff: 2", "Final Diff: 3"], (1, 3.0)),
    ("giraph", ["Iteration 1 Diff: 5"], (1, 0.0)),                              # batch lines only
    ("mapreduce", ["Iteration 1 Diff: 5", "Iteration 2 Diff: 4"], (1, 4.0)),
    ("mapreduce", ["Final Diff: 2", "Iteration 3 Diff: 7"], (1, 2.0)),
    ("mapreduce", ["Job a completed successfully"] * 3 + ["Job b failed"], (3, 0.0)),
    ("mapreduce", ["Superstep 5 finished"], (1, 0.0)),                          # BSP lines only
    ("mapreduce", ["nothing here"], (1, 0.0)),
]


def test_job_logs_one_by_one(spark):
    rows = [(f"j{j}", algo, i, x) for j, (algo, lines, _) in enumerate(JOB_LOGS)
            for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "job_id string, algo string, pos bigint, value string")
    got = {r["job_id"]: r for r in TM.log_summary(parse_job_log(df)).collect()}
    for j, (_, lines, want) in enumerate(JOB_LOGS):
        r = got[f"j{j}"]
        assert (r["iterations_to_converge"], r["final_diff"]) == (want[0], pytest.approx(want[1])), lines
