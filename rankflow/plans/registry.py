"""Registered queries: (spark, sf_dir) -> DataFrame, one per operator group.

Every query reads the driver's tables (or data Spark derives from them) in
full.  Computed doubles are rounded to 6 decimals, arrays are returned as
joined text plus a count, so the DuckDB oracle can match them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exact_sum
from ..operators import benchstats as BS
from ..operators import graph as G
from ..operators import rank as R
from ..operators import telemetry as TM
from ..operators.ordered import next_in_group
from ..operators.vertex_program import link_rank_program, vertex_program
from ..plans import loop as L
from ..session import ensure_checkpoint_dir
from ..sinks import append_metrics, format_metrics, rank_lines, to_adjacency_tsv, to_vertex_json, \
    write_log_lines
from ..sources import tables as TB
from ..sources.logs import parse_job_log, parse_sar, read_log_lines
from ..sources.text import adjacency_graph, parse_adjacency_tsv, parse_edges, parse_vertex_json, \
    rejects, vertex_json_graph

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def r6(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or (c if isinstance(c, str) else None))


def _once(df: DataFrame) -> DataFrame:
    """``df``, computed once however often it is read (a reliable checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _joined(c: str) -> F.Column:
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",")


# ------------------------------------------------------------------ sources

@query("parse_edges")
def q_parse_edges(spark, sf):
    return parse_edges(TB.edge_text_lines(spark, sf))


def _supply_adj(spark, sf):
    return G.adjacency(TB.supply_edges(spark, sf))


@query("edges_to_tsv")
def q_edges_to_tsv(spark, sf):
    return to_adjacency_tsv(_supply_adj(spark, sf))


def _tsv_lines(spark, sf):
    good = to_adjacency_tsv(_supply_adj(spark, sf))
    sup = TB.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    bad = sup.select(F.concat(F.lit("S"), "k").alias("value")).unionByName(
        sup.select(F.concat(F.lit("X"), "k", F.lit("\tx\t"), "k").alias("value")))
    return good.unionByName(bad)


@query("parse_tsv")
def q_parse_tsv(spark, sf):
    p = parse_adjacency_tsv(_tsv_lines(spark, sf))
    return p.select("id", "rank", F.size("nbrs").alias("n_nbrs"),
                    F.array_join("nbrs", ",").alias("nbrs"))


def _co_adj(spark, sf):
    return G.adjacency(TB.co_purchase_edges(spark, sf))


@query("edges_to_json")
def q_edges_to_json(spark, sf):
    return to_vertex_json(_co_adj(spark, sf))


@query("edges_to_json_python")
def q_edges_to_json_python(spark, sf):
    return to_vertex_json(_co_adj(spark, sf), style="python")


@query("parse_json")
def q_parse_json(spark, sf):
    p = parse_vertex_json(to_vertex_json(_co_adj(spark, sf)))
    return p.select("id", "value", F.size("edges").alias("n_edges"),
                    F.array_join(F.transform("edges", lambda x: x["dst"].cast("string")),
                                 ",").alias("dsts"),
                    F.aggregate("edges", F.lit(0.0),
                                lambda acc, x: acc + x["weight"].cast("double"))
                    .alias("weight_sum"))


# Ids above 2^53, which a double cannot hold.
BIG = 2 ** 53 + 1


def _big_lines(spark, sf):
    e = TB.co_purchase_edges(spark, sf)
    return to_vertex_json(G.adjacency(e.select((F.col("src") + BIG).alias("src"),
                                               (F.col("dst") + BIG).alias("dst"))))


@query("parse_json_big_ids")
def q_parse_json_big_ids(spark, sf):
    p = parse_vertex_json(_big_lines(spark, sf))
    return p.select("id", F.size("edges").alias("n_edges"),
                    F.array_join(F.transform("edges", lambda x: x["dst"].cast("string")), ",").alias("dsts"))


@query("adjacency_input_order")
def q_adjacency_input_order(spark, sf):
    e = TB.co_purchase_edges_in_order(spark, sf)
    a = G.adjacency(e, order_col="pos")
    return a.select("id", F.size("nbrs").alias("n_nbrs"), _joined("nbrs").alias("nbrs"))


@query("next_in_hot_group")
def q_next_in_hot_group(spark, sf):
    # a third of the orders in one group, a null group, null values, numbers above 2^53
    li = TB.table(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 == 0, 7).when(F.col("l_orderkey") % 11 == 0, None)
        .otherwise(F.col("l_orderkey") + 100).cast("bigint").alias("grp"),
        "l_orderkey", *TB.ORDER_LINE_KEYS,
        F.when(F.col("l_partkey") % 17 != 0, F.col("l_partkey") * 2 + BIG).cast("bigint").alias("val"),
        F.col("l_extendedprice").alias("price"))
    out = next_in_group(li, "grp", ["l_orderkey", *TB.ORDER_LINE_KEYS], "val", out="next_val",
                        keep=["l_orderkey", "l_linenumber", "price"])
    return out.select("grp", "l_orderkey", "l_linenumber", "price", "val", "next_val")


# -------------------------------------------------------------------- graph

@query("vertex_set")
def q_vertex_set(spark, sf):
    return G.vertices(TB.co_purchase_edges(spark, sf))


@query("vertex_count")
def q_vertex_count(spark, sf):
    return G.vertices(TB.co_purchase_edges(spark, sf)).agg(
        F.count(F.lit(1)).alias("vertex_count"))


@query("out_degree")
def q_out_degree(spark, sf):
    return G.out_degrees(TB.co_purchase_edges(spark, sf))


@query("out_degree_sinks")
def q_out_degree_sinks(spark, sf):
    return G.out_degrees(TB.page_link_edges(spark, sf))


@query("adjacency_sorted")
def q_adjacency_sorted(spark, sf):
    a = _co_adj(spark, sf)
    return a.select("id", F.size("nbrs").alias("n_nbrs"), _joined("nbrs").alias("nbrs"))


@query("adjacency_parts")
def q_adjacency_parts(spark, sf):
    """Every neighbour with its place in its vertex's list, from parts of a
    few neighbours; the places of a part start after those of the parts before."""
    parts = G.adjacency_parts(TB.co_purchase_edges(spark, sf), part_edges=4).persist()
    sizes = parts.select("id", "part", F.size("nbrs").alias("n"))
    start = sizes.select("id", "part", (F.sum("n").over(Window.partitionBy("id").orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    return parts.join(start, ["id", "part"]).select(
        "id", (F.size("nbrs") < 8).alias("bounded"), "before", F.posexplode_outer("nbrs").alias("at", "nbr")).select(
        "id", "bounded", (F.col("before") + F.col("at") + 1).alias("place"), "nbr")


@query("explode_adjacency")
def q_explode_adjacency(spark, sf):
    return G.explode_adjacency(_supply_adj(spark, sf))


@query("init_ranks")
def q_init_ranks(spark, sf):
    return G.init_ranks(G.vertices(TB.co_purchase_edges(spark, sf)))


# ------------------------------------------------------------- single step

def _init(spark, sf, graph="co_purchase"):
    e = TB.GRAPHS[graph](spark, sf)
    return e, G.init_ranks(G.vertices(e))


@query("contributions")
def q_contributions(spark, sf):
    e, r = _init(spark, sf)
    return R.contributions(e, r).select("dst", r6("vote"))


@query("rank_step")
def q_rank_step(spark, sf):
    e, r = _init(spark, sf)
    return R.rank_step(e, r).select("id", r6("rank"), r6("prev"))


@query("rank_step_sinks")
def q_rank_step_sinks(spark, sf):
    e, r = _init(spark, sf, "supply")
    return R.rank_step(e, r).select("id", r6("rank"), r6("prev"))


@query("l1_delta")
def q_l1_delta(spark, sf):
    e, r = _init(spark, sf)
    return R.rank_step(e, r).agg(r6(R.l1_delta_col(), "delta"))


@query("fixed_point_delta")
def q_fixed_point_delta(spark, sf):
    e, r = _init(spark, sf)
    return R.rank_step(e, r).agg(r6(R.fixed_point_delta_col(), "delta_fixed"))


# -------------------------------------------------------------------- loops

def _ranked(spark, sf, graph="co_purchase", **kw) -> L.RankResult:
    return L.rank_until(TB.GRAPHS[graph](spark, sf), **kw)


def _ranks_out(res: L.RankResult) -> DataFrame:
    return res.ranks.select("id", r6("rank"))


def _status_out(spark, res: L.RankResult) -> DataFrame:
    return res.status_frame(spark).select("status", "iterations", F.round("final_delta", 10).alias("final_delta"))


@query("rank_fixed_10")
def q_rank_fixed_10(spark, sf):
    return _ranks_out(_ranked(spark, sf, tol=None, max_iter=10))


@query("rank_fixed_30")
def q_rank_fixed_30(spark, sf):
    return _ranks_out(_ranked(spark, sf, tol=None, max_iter=30, packed=None))


@query("rank_until_l1")
def q_rank_until_l1(spark, sf):
    return _ranks_out(_ranked(spark, sf))


@query("rank_until_lag1")
def q_rank_until_lag1(spark, sf):
    return _ranks_out(_ranked(spark, sf, lag=1))


@query("rank_until_fixed_point")
def q_rank_until_fixed_point(spark, sf):
    return _ranks_out(_ranked(spark, sf, delta="fixed_point"))


@query("rank_status")
def q_rank_status(spark, sf):
    return _status_out(spark, _ranked(spark, sf))


@query("rank_status_fixed_point")
def q_rank_status_fixed_point(spark, sf):
    return _status_out(spark, _ranked(spark, sf, delta="fixed_point"))


@query("convergence_history")
def q_convergence_history(spark, sf):
    h = _ranked(spark, sf).history
    return h.select("iter", r6("delta"), r6("delta_fixed"))


@query("rank_capped")
def q_rank_capped(spark, sf):
    return _status_out(spark, _ranked(spark, sf, max_iter=5))


@query("rank_until_sinks")
def q_rank_until_sinks(spark, sf):
    return _ranks_out(_ranked(spark, sf, graph="supply"))


@query("rank_until_page_links")
def q_rank_until_page_links(spark, sf):
    return _ranks_out(_ranked(spark, sf, graph="page_links"))


@query("rank_until_salted")
def q_rank_until_salted(spark, sf):
    # The shuffle (salted) join path with buckets of at most 2 distinct
    # out-neighbours, so that every source with fan-out > 2 is split.
    return _ranks_out(_ranked(spark, sf, broadcast=False, salt_chunk=2))


@query("rank_lines")
def q_rank_lines(spark, sf):
    # K3 text form (id TAB rank) of the converged ranks, rounded to 6 decimals
    return rank_lines(_ranks_out(_ranked(spark, sf)))


@query("rank_tagged_union")
def q_rank_tagged_union(spark, sf):
    return L.rank_tagged_fixed(TB.co_purchase_edges(spark, sf), 10).select("id", r6("rank"))


@query("vertex_program_rank")
def q_vertex_program_rank(spark, sf):
    res = link_rank_program(TB.co_purchase_edges(spark, sf))
    return res.vertices.select("id", r6("rank"))


@query("vertex_program_from_json")
def q_vertex_program_from_json(spark, sf):
    # the BSP input path: vertex JSON lines (K2) -> parsed (S3) -> program
    vj = _once(parse_vertex_json(to_vertex_json(_co_adj(spark, sf))))
    edges = vj.select(F.col("id").alias("src"), F.explode("edges").alias("e")).select(
        "src", F.col("e.dst").alias("dst"))
    res = vertex_program(
        edges, vertices=vj.select("id", F.col("value").alias("v0")),
        init={"rank": F.coalesce("v0", F.lit(1.0))},
        send=F.col("rank") / F.col("outdeg"),
        update={"rank": F.lit(R.BASE) + F.lit(R.DAMPING) * F.coalesce("msg", F.lit(0.0))},
        aggregators={"sum_diff": F.sum(F.abs(F.col("rank") - F.col("old_rank")))},
        halt=lambda s, agg: s > 1 and agg["sum_diff"] < L.TOLERANCE)
    return res.vertices.select("id", r6("rank"))


@query("vertex_program_big_ids")
def q_vertex_program_big_ids(spark, sf):
    vj = parse_vertex_json(_big_lines(spark, sf))
    edges = vj.select(F.col("id").alias("src"), F.explode("edges").alias("e")).select(
        "src", F.col("e.dst").alias("dst"))
    return link_rank_program(edges).vertices.select("id", r6("rank"))


@query("snapshot_resume")
def q_snapshot_resume(spark, sf):
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/snapshots-{uuid.uuid4().hex}"
    g = L.prepare(TB.co_purchase_edges(spark, sf))
    broken = L.run(g, max_iter=4, checkpoint_every=2, snapshot_dir=base)     # interrupted run
    broken.state.write.parquet(f"{base}/iter=6")        # a snapshot without its marker
    res = L.run(g, checkpoint_every=2, snapshot_dir=base, resume=True)
    return res.ranks.select("id", r6("rank"))


@query("rank_from_saved_graph")
def q_rank_from_saved_graph(spark, sf):
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/graph-{uuid.uuid4().hex}"
    g = L.prepare(TB.co_purchase_edges(spark, sf), salt_chunk=20)
    L.save_graph(g, base)
    g.release()
    return L.run(L.load_graph(spark, base)).ranks.select("id", r6("rank"))


# ----------------------------------------- adjacency state as rank input

def _ranked_tsv_lines(spark, sf):
    """Adjacency lines with start ranks other than 1: the co-purchase graph
    without the lines of every seventh part (targets that nobody declares),
    and all customers as vertices without an edge."""
    parts = _co_adj(spark, sf).where(F.col("id") % 7 != 0).select(
        F.col("id").cast("string").alias("id"), F.transform("nbrs", lambda x: x.cast("string")).alias("nbrs"),
        (F.col("id") % 5 + 1).cast("double").alias("rank"))
    alone = TB.table(spark, sf, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"),
        F.array().cast("array<string>").alias("nbrs"), (F.col("c_custkey") % 3 + 0.5).cast("double").alias("rank"))
    return to_adjacency_tsv(parts.unionByName(alone), rank="rank")


def _adjacency_ranked(spark, sf, **kw) -> L.RankResult:
    edges, vertices = adjacency_graph(_once(parse_adjacency_tsv(_ranked_tsv_lines(spark, sf))))
    return L.rank_until(edges, vertices=vertices, start=0.0, **kw)


@query("rank_from_adjacency")
def q_rank_from_adjacency(spark, sf):
    return _ranks_out(_adjacency_ranked(spark, sf, delta="fixed_point", packed=None))


@query("rank_status_from_adjacency")
def q_rank_status_from_adjacency(spark, sf):
    return _status_out(spark, _adjacency_ranked(spark, sf, delta="fixed_point", packed=None))


@query("rank_fixed_from_adjacency")
def q_rank_fixed_from_adjacency(spark, sf):
    return _ranks_out(_adjacency_ranked(spark, sf, tol=None, max_iter=10))


@query("parse_rejects")
def q_parse_rejects(spark, sf):
    sup = TB.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    broken = ["[%s,1.0", "[\"a%s\",1.0,[]]", "[%s,\"z\",[]]", "[%s,1.0,[[%s]]]", "[%s,1.0,[[%s,0],[\"b\",1]]]"]
    json_lines = to_vertex_json(_co_adj(spark, sf)).unionByName(
        sup.select(F.explode(F.array(*[F.replace(F.lit(b), F.lit("%s"), F.col("k")) for b in broken])).alias("value")))
    lines = {"edges": TB.edge_text_lines(spark, sf), "tsv": _tsv_lines(spark, sf), "json": json_lines}
    out = [rejects(df, fmt).select(F.lit(fmt).alias("format"), "value", "reason") for fmt, df in lines.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# -------------------------------------------- results to the last binary place

@query("rank_until_exact")
def q_rank_until_exact(spark, sf):
    return _ranked(spark, sf).ranks.select("id", "rank")


@query("rank_status_exact")
def q_rank_status_exact(spark, sf):
    return _ranked(spark, sf).status_frame(spark).select("status", "iterations", "final_delta")


# ------------------------------------------------------------ vertex programs

@query("vertex_program_vertex_halt")
def q_vertex_program_vertex_halt(spark, sf):
    # the vertices themselves halt, by the sum of changes of the superstep before
    res = vertex_program(
        TB.co_purchase_edges(spark, sf),
        init={"rank": F.lit(1.0)},
        send=F.col("rank") / F.col("outdeg"),
        update={"rank": F.lit(R.BASE) + F.lit(R.DAMPING) * F.coalesce("msg", F.lit(0.0))},
        aggregators={"sum_diff": exact_sum(F.abs(F.col("rank") - F.col("old_rank")))},
        vote_to_halt=(F.col("superstep") > 1) & (F.col("agg_sum_diff") < L.TOLERANCE))
    return res.vertices.select("id", r6("rank"))


@query("vertex_program_two_fields")
def q_vertex_program_two_fields(spark, sf):
    # hops from the smallest part, and the smallest neighbour that is one hop nearer
    edges = _once(TB.co_purchase_edges(spark, sf))
    root = edges.agg(F.min("src")).first()[0]
    reached = F.col("best.hops")
    res = vertex_program(
        edges,
        init={"hops": F.when(F.col("id") == F.lit(root), 0).cast("bigint"),
              "parent": F.lit(None).cast("bigint")},
        send={"hops": F.col("hops") + 1, "parent": F.col("id")},
        combine={"best": F.min(F.when(F.col("hops").isNotNull(), F.struct("hops", "parent")))},
        update={"hops": F.coalesce("hops", reached),
                "parent": F.when(F.col("hops").isNull(), F.col("best.parent")).otherwise(F.col("parent"))},
        vote_to_halt=F.col("old_hops").isNotNull() | F.col("hops").isNull())
    return res.vertices.select("id", "hops", "parent")


@query("vertex_program_labels")
def q_vertex_program_labels(spark, sf):
    # five rounds of the most frequent label among the in-neighbours (ties: the smallest)
    res = vertex_program(
        TB.co_purchase_edges(spark, sf),
        init={"label": F.col("id")},
        send={"label": F.col("label")},
        combine={"best": F.max(F.struct("mult", (-F.col("label")).alias("minus")))}, count_equal=True,
        update={"label": F.coalesce(-F.col("best.minus"), F.col("label"))},
        max_supersteps=5)
    return res.vertices.select("id", "label")


@query("vertex_program_weighted")
def q_vertex_program_weighted(spark, sf):
    # vertex JSON with edge weights (a quarter to one): votes are shared by weight
    adj = _co_adj(spark, sf).select("id", F.transform("nbrs", lambda x: F.struct(
        x.alias("dst"), ((x % 4 + 1) / 4.0).cast("float").alias("weight"))).alias("nbrs"))
    vj = _once(parse_vertex_json(to_vertex_json(adj)))
    edges, _ = vertex_json_graph(vj)
    total = F.aggregate("edges", F.lit(0.0), lambda acc, e: acc + e["weight"])
    res = vertex_program(
        edges, vertices=vj.select("id", total.alias("total")), values=("weight",),
        init={"rank": F.lit(1.0), "total": F.col("total")},
        send=F.col("rank") / F.col("total"), along={"m": F.col("m") * F.col("weight")},
        update={"rank": F.lit(R.BASE) + F.lit(R.DAMPING) * F.coalesce("msg", F.lit(0.0)), "total": F.col("total")},
        aggregators={"sum_diff": exact_sum(F.abs(F.col("rank") - F.col("old_rank")))},
        halt=lambda s, agg: s > 1 and agg["sum_diff"] < L.TOLERANCE)
    return res.vertices.select("id", r6("rank"))


def names() -> list[str]:
    return list(REGISTRY)


def get(name: str) -> Query:
    return REGISTRY[name]




# ---------------------------------------------------------------- telemetry



def _parsed(spark, sf):
    return parse_job_log(TB.job_log_lines(spark, sf))


def _samples(spark, sf):
    return parse_sar(TB.monitor_lines(spark, sf))


@query("log_files_round_trip")
def q_log_files_round_trip(spark, sf):
    # one log per algorithm and dataset, written in parts, read in splits of
    # 16 kB: every line with the one that follows it
    lines = TB.job_log_lines(spark, sf).withColumn("job_id", F.regexp_extract("job_id", "^([^_]+_[^_]+)_", 1))
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/logs-{uuid.uuid4().hex}"
    write_log_lines(lines, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        back = read_log_lines(spark, f"{path}/*.log").select("job_id", "pos.part", "pos.block", "pos.row", "value")
        out = next_in_group(back, "job_id", ["part", "block", "row"], "value")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    return out


@query("job_log_parsed")
def q_job_log_parsed(spark, sf):
    p = _parsed(spark, sf)
    return p.select("job_id", "pos", *[r6(c) for c in ("final_diff", "total_diff",
                                                         "any_diff", "cand_diff")],
                    "superstep", "success")


@query("sar_samples")
def q_sar_samples(spark, sf):
    s = _samples(spark, sf)
    return s.select("job_id", "pos", "kind", "iface",
                    *[r6(c) for c in ("cpu_user", "cpu_system", "kbmemused", "rx_kb_s",
                                      "tx_kb_s", "compat_a", "compat_b")])


@query("job_iterations")
def q_job_iterations(spark, sf):
    return TM.iterations(_parsed(spark, sf))


@query("final_diff")
def q_final_diff(spark, sf):
    return TM.final_diff(_parsed(spark, sf)).select("job_id", r6("final_diff"))


@query("cpu_util")
def q_cpu_util(spark, sf):
    return TM.cpu_util(_samples(spark, sf)).select("job_id", r6("cpu_utilization"))


@query("peak_mem")
def q_peak_mem(spark, sf):
    return TM.peak_mem_gb(_samples(spark, sf)).select("job_id", r6("peak_memory_usage"))


@query("network_mb")
def q_network_mb(spark, sf):
    n = TM.network_mb(_samples(spark, sf), TB.job_runs(spark, sf))
    return n.select("job_id", r6("network_communication"))


@query("network_mb_compat")
def q_network_mb_compat(spark, sf):
    n = TM.network_mb_compat(_samples(spark, sf), TB.job_runs(spark, sf))
    return n.select("job_id", r6("network_communication"))


METRIC_DOUBLES = ("total_execution_time", "avg_iteration_time", "network_communication",
                  "peak_memory_usage", "final_diff", "cpu_utilization")


def _job_metrics(spark, sf, network="interface"):
    return TM.job_metrics(_parsed(spark, sf), _samples(spark, sf), TB.job_runs(spark, sf),
                          network=network)


@query("job_metrics")
def q_job_metrics(spark, sf):
    m = _job_metrics(spark, sf)
    return m.select("algorithm", "dataset", "job_id", "iterations_to_converge",
                    *[r6(c) for c in METRIC_DOUBLES])


@query("metrics_csv")
def q_metrics_csv(spark, sf):
    return format_metrics(_job_metrics(spark, sf, network="as_coded"))


@query("convergence_rate")
def q_convergence_rate(spark, sf):
    m = TM.log_summary(_parsed(spark, sf))
    it = F.col("iterations_to_converge")
    return m.select("job_id",
                    r6(TM.convergence_rate(1.0, F.col("final_diff"), it), "convergence_rate"),
                    # the collection script's constants: initial 1.0, final 0.0001
                    r6(TM.convergence_rate(1.0, 0.0001, it), "convergence_rate_script"))


@query("bytes_sent")
def q_bytes_sent(spark, sf):
    return TM.bytes_sent_mb(TB.job_log_lines(spark, sf)).select("job_id", r6("bytes_sent_mb"))


@query("shuffle_estimate")
def q_shuffle_estimate(spark, sf):
    return TM.shuffle_mb_estimate(TB.job_log_lines(spark, sf)).select("job_id", r6("shuffle_mb"))


@query("max_memory")
def q_max_memory(spark, sf):
    return TM.max_memory_gb(TB.job_log_lines(spark, sf)).select("job_id", r6("max_memory_gb"))


@query("collected_metrics")
def q_collected_metrics(spark, sf):
    m = TM.collected_metrics(TB.job_log_lines(spark, sf))
    return m.select("algorithm", "job_id", "iterations_to_converge", *[r6(c) for c in (
        "total_execution_time", "avg_iteration_time", "network_communication", "peak_memory_usage",
        "convergence_rate", "mean_superstep_time")])


@query("log_value")
def q_log_value(spark, sf):
    lines = TB.job_log_lines(spark, sf)
    a = TM.log_value(lines, "Total execution time", 5, name="exec_time")
    b = TM.log_value(lines, "Run time", 4, scale=1000.0, name="run_time")
    return a.join(b, "job_id").select("job_id", r6("exec_time"), r6("run_time"))


@query("count_lines")
def q_count_lines(spark, sf):
    lines = TB.job_log_lines(spark, sf)
    a = TM.count_lines(lines, "Superstep", name="superstep_lines")
    b = TM.count_lines(lines, "Reduce", "SUCCEEDED", name="reduce_succeeded")
    return a.join(b, "job_id")


# ---------------------------------------------------------- benchmark stats



def _typed(spark, sf):
    return BS.typed_metrics(BS.parse_metrics_lines(TB.metrics_lines(spark, sf)))


def _avg(spark, sf):
    return BS.average_metrics(_typed(spark, sf))


@query("metrics_raw")
def q_metrics_raw(spark, sf):
    return BS.parse_metrics_lines(TB.metrics_lines(spark, sf))


@query("strip_units")
def q_strip_units(spark, sf):
    t = _typed(spark, sf)
    return t.select("algorithm", "dataset", "job_id", "iterations_to_converge",
                    *[r6(c) for c in BS.UNIT_COLUMNS], r6("final_diff"))


@query("metrics_header_variants")
def q_metrics_header_variants(spark, sf):
    t = BS.typed_metrics(BS.parse_metrics_text(TB.metrics_files(spark, sf)))
    return t.select("algorithm", "dataset", "job_id", "iterations_to_converge",
                    *[r6(c) for c in BS.UNIT_COLUMNS], r6("final_diff"),
                    r6("convergence_rate"))


@query("metrics_append_round_trip")
def q_metrics_append_round_trip(spark, sf):
    # appended in two runs to one folder, read back with its headers
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/metrics-{uuid.uuid4().hex}"
    m = _once(_job_metrics(spark, sf, network="as_coded"))
    for algo in ("giraph", "mapreduce"):
        append_metrics(m.where(F.col("algorithm") == algo), path)
    return BS.read_metrics_csv(spark, path).select(*BS.RAW_COLUMNS)


@query("presentation_order")
def q_presentation_order(spark, sf):
    out = BS.presentation_order(_avg(spark, sf), TB.dataset_sizes(spark, sf), "algorithm")
    return out.select("ord", "dataset", "algorithm", "runs")


@query("dataset_dim_rows")
def q_dataset_dim_rows(spark, sf):
    # the explicit dimension: a handful of datasets, given as rows
    rows = [tuple(r) for r in TB.dataset_sizes(spark, sf).select("dataset", "ord", "file", "edges").collect()]
    return BS.dataset_dim(spark, rows)


@query("dataset_dim")
def q_dataset_dim(spark, sf):
    return TB.dataset_sizes(spark, sf)


@query("average_metrics")
def q_average_metrics(spark, sf):
    return _avg(spark, sf).select("dataset", "algorithm", "runs",
                                  *[r6(c) for c in BS.AVERAGED])


@query("normalized_iter_time")
def q_normalized_iter_time(spark, sf):
    n = BS.normalized_iter_time(_avg(spark, sf), TB.dataset_sizes(spark, sf))
    return n.select("dataset", "algorithm", "edges", r6("avg_iteration_time"),
                    r6("time_per_m_edges"))


@query("metric_ratios")
def q_metric_ratios(spark, sf):
    r = BS.metric_ratios(_avg(spark, sf), "mapreduce", "giraph")
    return r.select("dataset", *[r6(c) for c in ("time_ratio", "iter_ratio",
                                                  "network_ratio", "memory_ratio")])


@query("scaling_exponent")
def q_scaling_exponent(spark, sf):
    s = BS.scaling_exponent(_avg(spark, sf), TB.dataset_sizes(spark, sf))
    return s.select("algorithm", "dataset", "ord", "edges", r6("time"), r6("slope"))


@query("memory_speedup")
def q_memory_speedup(spark, sf):
    m = BS.memory_speedup(_avg(spark, sf), "giraph", "mapreduce")
    return m.select("dataset", r6("mem_ratio"), r6("speedup"))
