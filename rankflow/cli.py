"""Command line: the study's workflow as Spark jobs.

    python -m rankflow preprocess EDGES OUT_TSV OUT_JSON [--part-edges N]
    python -m rankflow rank INPUT OUT [--format edges|tsv|json] [--delta l1|fixed_point]
                       [--tol 1e-4] [--max-iter 500] [--lag 0] [--snapshot-dir DIR] [--resume]
                       [--partitions N] [--salt-chunk N] [--strict]
    python -m rankflow metrics --runs RUNS_CSV --logs GLOB --monitor GLOB OUT
                       [--network interface|as_coded]
    python -m rankflow stats METRICS_CSV... --dataset NAME:ORD:EDGES ... [--num A --den B]

``rank`` prints one ``Iteration i Diff: d`` line per update (from 0) and a
``Final Diff:`` at the end, which ``metrics`` reads back as a job log.
All work runs on the session the command builds (``spark.checkpoint.dir``
from the cluster's configuration; a local folder only in local mode).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .operators import benchstats as BS
from .operators import graph as G
from .operators import telemetry as TM
from .plans import loop as L
from .session import ensure_checkpoint_dir
from .sinks import append_metrics, format_metrics, write_adjacency_tsv, write_ranks, \
    write_vertex_json
from .sources.logs import parse_job_log, parse_sar, read_log_lines
from .sources.text import adjacency_graph, count_rejects, parse_adjacency_tsv, parse_edges, \
    parse_vertex_json, read_lines, vertex_json_graph


def _num(x: float) -> str:
    """A double as the log rules read it (exponent marker 'E', as Java prints)."""
    return repr(float(x)).replace("e", "E")


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("rankflow").getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _graph(spark: SparkSession, path: str, fmt: str, seen: Observation) -> tuple:
    """Edges, declared vertices (id, rank) and the start value of the others.

    An edge list declares nothing: every vertex starts from 1.  The adjacency
    formats declare their vertices, also those without an edge; a vertex that
    is a target only starts from 0.  The start ranks are those of the TSV
    rows, and 1 for vertex JSON, whose values the BSP program sets anew.
    Rejected lines are counted into ``seen`` by the job that reads them.
    """
    lines = read_lines(spark, path)
    checked = count_rejects(lines, fmt, seen)
    if fmt == "edges":
        return parse_edges(checked), None, 1.0
    if fmt == "tsv":
        return *(adjacency_graph(parse_adjacency_tsv(x))[k] for k, x in enumerate((lines, checked))), 0.0
    edges, vertices = (vertex_json_graph(parse_vertex_json(x))[k] for k, x in enumerate((lines, checked)))
    return edges.select("src", "dst"), vertices.select("id", F.lit(1.0).alias("rank")), 0.0


def cmd_preprocess(a) -> int:
    spark = _session()
    edges = parse_edges(read_lines(spark, a.edges, order=True), keep=("pos",))
    # neighbours in the order of the input lines, computed once for all outputs;
    # a vertex of more than a part's neighbours gets several lines
    adj = G.adjacency_parts(edges, order_col="pos", part_edges=a.part_edges).persist()
    print(f"Nodes: {adj.select('id').distinct().count()}. Writing outputs...")
    write_adjacency_tsv(adj, a.out_tsv)
    write_vertex_json(adj, a.out_json)
    adj.unpersist()
    return 0


def cmd_rank(a) -> int:
    spark = _session()
    seen = Observation("rankflow_lines")
    edges, vertices, start = _graph(spark, a.input, a.format, seen)
    g = L.prepare(edges, num_partitions=a.partitions, salt_chunk=a.salt_chunk, vertices=vertices, start=start)
    bad = {k: n for k, n in seen.get.items() if k != "lines" and n}
    for reason, n in bad.items():
        print(f"Rejected lines: {n} ({reason})", file=sys.stderr)
    if bad and a.strict:
        return 1
    res = L.run(g, max_iter=a.max_iter, tol=a.tol, delta=a.delta, lag=a.lag,
                snapshot_dir=a.snapshot_dir, resume=a.resume)
    col = "delta" if a.delta == "l1" else "delta_fixed"
    for r in res.history.orderBy("iter").collect():      # one row per update
        print(f"Iteration {r['iter'] - 1} Diff: {_num(r[col])}")
    if res.status == "converged":
        print(f"Final Diff: {_num(res.final_delta)}")
        print(f"Converged at iteration {res.iterations}")
    else:
        print(f"Reached max iterations ({res.iterations}) without full convergence. "
              f"Final Diff: {_num(res.final_delta)}")
    write_ranks(res.ranks, a.out)
    return 0


def cmd_metrics(a) -> int:
    spark = _session()
    runs = spark.read.option("header", True).schema(
        "job_id string, algorithm string, dataset string, total_time double").csv(a.runs)
    logs = read_log_lines(spark, a.logs)
    mon = read_log_lines(spark, a.monitor)
    m = TM.job_metrics(parse_job_log(logs), parse_sar(mon), runs, network=a.network).persist()
    append_metrics(m, a.out)
    # one row per job, a partition at a time
    for r in format_metrics(m).orderBy("value").toLocalIterator():
        print(r["value"])
    m.unpersist()
    return 0


def _cell(v) -> str:
    return "NULL" if v is None else str(v)


def cmd_stats(a) -> int:
    spark = _session()
    dims = []
    for d in a.dataset:
        name, ord_, edges = d.split(":")
        dims.append((name, int(ord_), f"{name}", int(edges)))
    dim = BS.dataset_dim(spark, dims)
    avg = BS.average_metrics(BS.typed_metrics(BS.read_metrics_csv(spark, *a.metrics))).persist()
    tables = [("averages", BS.presentation_order(avg, dim, "algorithm")),
              ("ratios", BS.presentation_order(BS.metric_ratios(avg, a.num, a.den), dim)),
              ("time per iteration and 1 M edges",
               BS.presentation_order(BS.normalized_iter_time(avg, dim), dim, "algorithm")),
              ("log-log slopes", BS.scaling_exponent(avg, dim).orderBy("algorithm", "ord")),
              ("memory and speed-up",
               BS.presentation_order(BS.memory_speedup(avg, a.den, a.num), dim))]
    for title, df in tables:
        df = df.drop("ord")
        print(f"=== {title}")
        print("\t".join(df.columns))
        for r in df.toLocalIterator():      # all rows, a partition at a time
            print("\t".join(map(_cell, r)))
    avg.unpersist()
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rankflow", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="cmd", required=True)
    pp = sub.add_parser("preprocess")
    pp.add_argument("edges")
    pp.add_argument("out_tsv")
    pp.add_argument("out_json")
    pp.add_argument("--part-edges", type=int, default=G.PART_EDGES)
    pr = sub.add_parser("rank")
    pr.add_argument("input")
    pr.add_argument("out")
    pr.add_argument("--format", choices=["edges", "tsv", "json"], default="edges")
    pr.add_argument("--delta", choices=["l1", "fixed_point"], default="l1")
    pr.add_argument("--tol", type=float, default=L.TOLERANCE)
    pr.add_argument("--max-iter", type=int, default=L.MAX_ITERATIONS)
    pr.add_argument("--lag", type=int, default=0)
    pr.add_argument("--snapshot-dir")
    pr.add_argument("--resume", action="store_true")
    pr.add_argument("--strict", action="store_true", help="stop if a line of the input is rejected")
    pr.add_argument("--partitions", type=int, help="loop partitions (default: sized by edges)")
    pr.add_argument("--salt-chunk", type=int, default=L.SALT_CHUNK,
                    help="distinct targets per bucket of a hot source")
    pm = sub.add_parser("metrics")
    pm.add_argument("out")
    pm.add_argument("--runs", required=True)
    pm.add_argument("--logs", required=True)
    pm.add_argument("--monitor", required=True)
    pm.add_argument("--network", choices=["interface", "as_coded"], default="interface")
    ps = sub.add_parser("stats")
    ps.add_argument("metrics", nargs="+")
    ps.add_argument("--dataset", action="append", required=True)
    ps.add_argument("--num", default="mapreduce")
    ps.add_argument("--den", default="giraph")
    a = p.parse_args(argv)
    return {"preprocess": cmd_preprocess, "rank": cmd_rank, "metrics": cmd_metrics,
            "stats": cmd_stats}[a.cmd](a)


if __name__ == "__main__":
    sys.exit(main())
