"""Benchmark statistics on FIXTURES section 6."""

import pytest

from rankflow.operators import benchstats as BS

ROWS = """a,small,a_small_1,10.00s,0.50s,100.00MB,2.00GB,20,0.000000,10.00%
a,small,a_small_2,12.00s,0.50s,100.00MB,2.00GB,20,0.000000,10.00%
b,small,b_small_1,110.00s,5.50s,0.00MB,4.00GB,20,0.000080,10.00%
a,large,a_large_1,44.00s,1.00s,200.00MB,3.00GB,44,0.000000,10.00%
b,large,b_large_1,220.00s,5.00s,800.00MB,3.00GB,44,0.000080,10.00%
a,huge,a_huge_1,50.00s,1.00s,10.00MB,3.00GB,50,0.000000,10.00%""".splitlines()


@pytest.fixture()
def avg(spark):
    lines = spark.createDataFrame([(x,) for x in ROWS], "value string")
    return BS.average_metrics(BS.typed_metrics(BS.parse_metrics_lines(lines)))


@pytest.fixture()
def dim(spark):
    return BS.dataset_dim(spark, [("small", 1, "s.txt", 1000), ("large", 2, "l.txt", 4000),
                                  ("huge", 3, "h.txt", 4000)])


def test_means_and_ratios(avg):
    a = {(r["dataset"], r["algorithm"]): r for r in avg.collect()}
    assert a[("small", "a")]["total_execution_time"] == 11.0
    r = {x["dataset"]: x for x in BS.metric_ratios(avg, "b", "a").collect()}
    assert set(r) == {"small", "large"}          # huge has one algorithm only
    assert r["small"]["time_ratio"] == pytest.approx(10.0)
    assert r["large"]["time_ratio"] == pytest.approx(5.0)
    assert r["small"]["network_ratio"] == 0.0 and r["large"]["network_ratio"] == 4.0
    inv = {x["dataset"]: x for x in BS.metric_ratios(avg, "a", "b").collect()}
    assert inv["small"]["network_ratio"] == 0.0  # denominator 0 rule
    assert inv["small"]["memory_ratio"] == 0.5 and inv["large"]["memory_ratio"] == 1.0


def test_normalized_and_slopes(avg, dim):
    n = {(x["dataset"], x["algorithm"]): x["time_per_m_edges"]
         for x in BS.normalized_iter_time(avg, dim).collect()}
    assert n[("small", "a")] == pytest.approx(500.0) and n[("large", "a")] == pytest.approx(250.0)
    s = {(x["algorithm"], x["dataset"]): x["slope"] for x in BS.scaling_exponent(avg, dim).collect()}
    assert s[("a", "small")] is None
    assert s[("a", "large")] == pytest.approx(1.0) and s[("b", "large")] == pytest.approx(0.5)
    assert s[("a", "huge")] is None               # equal edge counts


def test_units_and_header_variants(spark, tmp_path):
    t = BS.typed_metrics(spark.createDataFrame(
        [("x", "d", "j", "1E-5", "", "1.2.3", "3GB", "7", "0.1", "99.90%")],
        ", ".join(f"{c} string" for c in BS.RAW_COLUMNS))).collect()[0]
    assert t["total_execution_time"] == 15.0 and t["avg_iteration_time"] == 0.0
    assert t["network_communication"] == 0.0 and t["cpu_utilization"] == 99.9
    f1 = tmp_path / "m1.csv"
    f1.write_text("algorithm,dataset,job_id,total_execution_time,avg_iteration_time,"
                  "network_communication,peak_memory_usage,iterations_to_converge,final_diff,"
                  "cpu_utilization\n" + ROWS[0] + "\n")
    f2 = tmp_path / "m2.csv"
    f2.write_text("algorithm,dataset,job_id,total_execution_time,avg_iteration_time,"
                  "network_communication,peak_memory_usage,iterations_to_converge,"
                  "convergence_rate,cpu_utilization\n"
                  "a,small,a1,39.00s,0.39s,1.00MB,3.12GB,100,99.90%,17.44%\n")
    raw = BS.read_metrics_csv(spark, str(f1), str(f2))
    assert {"final_diff", "convergence_rate"} <= set(raw.columns) and raw.count() == 2
    typed = {r["job_id"]: r for r in BS.typed_metrics(raw).collect()}
    assert typed["a1"]["convergence_rate"] == pytest.approx(99.9)
    assert typed["a_small_1"]["final_diff"] == 0.0


def test_metrics_csv_with_glob_characters_in_names(spark, tmp_path):
    f = tmp_path / "giraph_small_{1}.csv"
    f.write_text("algorithm,dataset,job_id,total_execution_time,avg_iteration_time,"
                 "network_communication,peak_memory_usage,iterations_to_converge,final_diff,"
                 "cpu_utilization\n" + ROWS[0] + "\n\n")
    raw = BS.read_metrics_csv(spark, str(tmp_path))
    assert [r["job_id"] for r in raw.collect()] == ["a_small_1"]


def test_presentation_order(avg, dim):
    rows = BS.presentation_order(avg, dim, "algorithm").collect()
    assert [(r["dataset"], r["algorithm"]) for r in rows] == [
        ("small", "a"), ("small", "b"), ("large", "a"), ("large", "b"), ("huge", "a")]
