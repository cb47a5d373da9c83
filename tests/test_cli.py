"""The command line end to end on the fixture graph and logs."""

import pytest

from conftest import EDGE_LINES
from rankflow.cli import main
from test_rank import STOP26
from test_telemetry import BSP_LOG, SAR_12H


def _ranks(spark, path):
    return {r["value"].split("\t")[0]: float(r["value"].split("\t")[1])
            for r in spark.read.text(path).collect()}


def test_preprocess_rank_metrics_stats(spark, tmp_path, capsys):
    edges = tmp_path / "edges.txt"
    edges.write_text("\n".join(EDGE_LINES) + "\n")
    assert main(["preprocess", str(edges), str(tmp_path / "tsv"), str(tmp_path / "json")]) == 0
    assert "Nodes: 5." in capsys.readouterr().out

    for fmt, src in (("edges", edges), ("tsv", tmp_path / "tsv"), ("json", tmp_path / "json")):
        out = tmp_path / f"ranks_{fmt}"
        assert main(["rank", str(src), str(out), "--format", fmt]) == 0
        text = capsys.readouterr().out
        assert "Converged at iteration 26" in text and "Final Diff:" in text
        got = _ranks(spark, str(out))
        assert all(abs(got[k] - v) < 1e-6 for k, v in STOP26.items())

    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "giraph_small_1.log").write_text("\n".join(BSP_LOG) + "\n")
    (logs / "giraph_small_1_mon.log").write_text("\n".join(SAR_12H) + "\n")
    runs = tmp_path / "runs.csv"
    runs.write_text("job_id,algorithm,dataset,total_time\ngiraph_small_1,giraph,small,36\n")
    assert main(["metrics", str(tmp_path / "metrics"), "--runs", str(runs),
                 "--logs", str(logs / "giraph_small_1.log"),
                 "--monitor", str(logs / "*_mon.log"), "--network", "as_coded"]) == 0
    row = capsys.readouterr().out.strip().splitlines()[-1]
    assert row == "giraph,small,giraph_small_1,36.00s,3.00s,16.83MB,3.00GB,12,0.000250,24.00%"

    assert main(["stats", str(tmp_path / "metrics"), "--dataset", "small:1:1000",
                 "--num", "mapreduce", "--den", "giraph"]) == 0
    assert "=== averages" in capsys.readouterr().out


def test_rank_log_reads_back_as_a_batch_job_log(spark, tmp_path, capsys):
    from conftest import lines_df
    from rankflow.operators import telemetry as TM
    from rankflow.sources.logs import parse_job_log
    edges = tmp_path / "edges.txt"
    edges.write_text("\n".join(EDGE_LINES) + "\n")
    main(["rank", str(edges), str(tmp_path / "r"), "--delta", "fixed_point",
          "--partitions", "3", "--salt-chunk", "1"])
    lines = capsys.readouterr().out.strip().splitlines()
    summary = TM.log_summary(parse_job_log(lines_df(spark, lines, "b", "mapreduce"))).first()
    assert summary["final_diff"] == pytest.approx(6e-05)


def test_neighbours_keep_the_input_order(spark, tmp_path):
    edges = tmp_path / "e.txt"
    edges.write_text("1 10\n2 7\n1 2\n1 10\n1 3\n2 1\n")
    assert main(["preprocess", str(edges), str(tmp_path / "tsv"), str(tmp_path / "json")]) == 0
    got = {r["value"].split("\t")[0]: r["value"].split("\t")[2] for r in spark.read.text(str(tmp_path / "tsv")).collect()
           if r["value"].count("\t") > 1}
    assert got["1"] == "10,2,10,3" and got["2"] == "7,1"


def test_capped_log_reads_back(spark, tmp_path, capsys):
    from conftest import lines_df
    from rankflow.operators import telemetry as TM
    from rankflow.sources.logs import parse_job_log
    edges = tmp_path / "edges.txt"
    edges.write_text("\n".join(EDGE_LINES) + "\n")
    main(["rank", str(edges), str(tmp_path / "r"), "--max-iter", "2"])
    lines = capsys.readouterr().out.strip().splitlines()
    assert lines[0].startswith("Iteration 0 Diff:")
    last = float(lines[1].split()[-1])
    for algo in ("giraph", "mapreduce"):
        summary = TM.log_summary(parse_job_log(lines_df(spark, lines, "b", algo))).first()
        assert summary["final_diff"] == pytest.approx(last)


def test_stats_prints_all_rows(spark, tmp_path, capsys):
    from rankflow.operators.benchstats import RAW_COLUMNS
    rows = [f"giraph,d{i},j{i},{i + 1}.00s,1.00s,1.00MB,1.00GB,1,0.1,1.00%" for i in range(30)]
    (tmp_path / "m.csv").write_text("\n".join([",".join(RAW_COLUMNS), *rows, ",".join(RAW_COLUMNS)]) + "\n")
    args = ["stats", str(tmp_path / "m.csv")]
    for i in range(30):
        args += ["--dataset", f"d{i}:{i}:1000"]
    assert main(args) == 0
    out = capsys.readouterr().out
    averages = out.split("=== ")[1].strip().splitlines()
    assert len(averages) == 32 and averages[2].split("\t")[:3] == ["d0", "giraph", "1"]
