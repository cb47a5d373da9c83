"""Inputs derived from the driver's parquet tables.

The study ranks public graphs and parses job/monitor logs; the test tables
hold neither, so every input is derived from them with plain DataFrame
expressions (its size grows with the tables):

* ``co_purchase_edges``: consecutive parts of one order (lineitem).
* ``supply_edges``: supplier -> part, a bipartite graph whose targets are sinks.
* ``page_link_edges``: page -> href of every anchor in ``pages.html``.
* ``edge_text_lines``: raw edge-list text with comments, short lines, extra
  tokens and odd whitespace, so the text parser has real work.
* ``job_log_lines`` / ``monitor_lines`` / ``job_runs``: job logs, ``sar``
  monitor logs and run times, one job per user of ``events``.
* ``metrics_lines``: the header-less CSV rows of the metrics file, one per
  order of ``orders``.

The DuckDB oracle builds the same inputs with the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.benchstats import RAW_COLUMNS
from ..operators.ordered import next_in_group

# The order of lines inside one order, with enough columns that
# no ties remain.
ORDER_LINE_KEYS = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                   "l_extendedprice"]
# Anchor pattern for page links.
HREF_PATTERN = r'href="([^"]*)"'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def _cents(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col * 100).cast("bigint")


def fmt2(c: Column) -> Column:
    """Integer hundredths -> 'x.yy' text, exact in every engine."""
    return F.concat(_s(F.floor(c / 100)), F.lit("."),
                    F.lpad(_s(F.pmod(c, F.lit(100))), 2, "0"))


# ---------------------------------------------------------------- graphs

def _order_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the part of the next line of its order (null for the last)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *ORDER_LINE_KEYS)
    return next_in_group(li, "l_orderkey", ORDER_LINE_KEYS, "l_partkey",
                         out="next_partkey", keep=["l_linenumber"], count_first=True)


def co_purchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src bigint, dst bigint): each part points to the next part of its order."""
    s = _order_successors(spark, sf_dir)
    return s.where(F.col("next_partkey").isNotNull()).select(
        F.col("l_partkey").alias("src"), F.col("next_partkey").alias("dst"))


def co_purchase_edges_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, pos): the same edges with their place in the input."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *ORDER_LINE_KEYS)
    s = next_in_group(li, "l_orderkey", ORDER_LINE_KEYS, "l_partkey", out="next_partkey",
                      keep=ORDER_LINE_KEYS, count_first=True)
    return s.where(F.col("next_partkey").isNotNull()).select(
        F.col("l_partkey").alias("src"), F.col("next_partkey").alias("dst"),
        F.struct("l_orderkey", *ORDER_LINE_KEYS).alias("pos"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src string, dst string): supplier 'S<k>' -> part 'P<k>' per lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("S"), _s(F.col("l_suppkey"))).alias("src"),
                     F.concat(F.lit("P"), _s(F.col("l_partkey"))).alias("dst"))


def page_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src string, dst string): 'p<page_id>' -> every href of the page."""
    pg = table(spark, sf_dir, "pages")
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(HREF_PATTERN), F.lit(1))
    return pg.select(F.concat(F.lit("p"), _s(F.col("page_id"))).alias("src"),
                     F.explode(hrefs).alias("dst"))


GRAPHS = {
    "co_purchase": co_purchase_edges,
    "supply": supply_edges,
    "page_links": page_link_edges,
}


def edge_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value string): raw edge-list text whose parsed edges are co_purchase.

    The last line of every order has no successor and becomes a comment
    (even order key) or a one-token line (odd); edges are written in four
    layouts chosen by (src + dst) mod 4: tab, blank plus a third token,
    leading blank+tab with a double blank, and doubled/trailing tabs.
    """
    s = _order_successors(spark, sf_dir)
    src, dst = _s(F.col("l_partkey")), _s(F.col("next_partkey"))
    layout = F.pmod(F.col("l_partkey") + F.col("next_partkey"), F.lit(4))
    line = (
        F.when(F.col("next_partkey").isNull() & (F.pmod("l_orderkey", F.lit(2)) == 0),
               F.concat(F.lit("# order "), _s(F.col("l_orderkey"))))
        .when(F.col("next_partkey").isNull(), src)
        .when(layout == 0, F.concat(src, F.lit("\t"), dst))
        .when(layout == 1, F.concat(src, F.lit(" "), dst, F.lit(" "),
                                    _s(F.col("l_linenumber"))))
        .when(layout == 2, F.concat(F.lit(" \t"), src, F.lit("  "), dst))
        .otherwise(F.concat(src, F.lit("\t\t"), dst, F.lit("\t")))
    )
    return s.select(line.alias("value"))


# ------------------------------------------------------------- job logs

def _jobs(ev: DataFrame) -> DataFrame:
    algo = F.when(F.pmod("user_id", F.lit(2)) == 0, F.lit("giraph")).otherwise(
        F.lit("mapreduce"))
    dataset = (F.when(F.pmod("user_id", F.lit(3)) == 0, F.lit("small"))
               .when(F.pmod("user_id", F.lit(3)) == 1, F.lit("medium"))
               .otherwise(F.lit("large")))
    return ev.withColumn("algo", algo).withColumn("dataset", dataset).withColumn(
        "job_id", F.concat(F.col("algo"), F.lit("_"), F.col("dataset"), F.lit("_u"),
                           _s(F.col("user_id")))
    ).withColumn("c", _cents("value")).withColumn("sub", F.pmod("event_id", F.lit(4)))


def job_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, algo, pos, value): one job-log line per event."""
    ev = _jobs(table(spark, sf_dir, "events"))
    c, sub, et = F.col("c"), F.col("sub"), F.col("event_type")
    line = (
        F.when((et == "view") & (sub == 0),
               F.concat(F.lit("finishSuperstep: Superstep "),
                        _s(F.pmod(c, F.lit(50)) - 1), F.lit(" done")))
        .when((et == "view") & (sub == 1),
              F.concat(F.lit("INFO superstep "), _s(F.pmod(c, F.lit(50))),
                       F.lit(" completed in "), _s(c), F.lit(" ms")))
        .when((et == "view") & (sub == 2),
              F.concat(F.lit("Superstep "), _s(F.pmod(c, F.lit(50))), F.lit(" started")))
        .when(et == "view",
              F.concat(F.lit("Bytes sent "), _s(c * 1000), F.lit(" bytes")))
        .when((et == "click") & (sub == 2),
              F.concat(F.lit("Job Run time: "), _s(c * 10), F.lit(" ms")))
        .when(et == "click",
              F.concat(F.lit("Iteration "), _s(F.pmod(c, F.lit(100))), F.lit(" Diff: "),
                       _s(c), F.lit("E-5")))
        .when((et == "signup") & (sub <= 1),
              F.concat(F.lit("Job job_"), _s(F.col("event_id")),
                       F.lit(" completed successfully")))
        .when((et == "signup") & (sub == 2),
              F.concat(F.lit("  Map input records="), _s(c)))
        .when(et == "signup",
              F.concat(F.lit("Memory Used: "), _s(c), F.lit(" MB")))
        .when((et == "purchase") & (sub <= 1),
              F.concat(F.lit("Superstep="), _s(F.pmod(c, F.lit(40))),
                       F.lit(" completed, Total Diff: "), _s(c), F.lit("E-6")))
        .when((et == "purchase") & (sub == 2),
              F.concat(F.lit("INFO Total execution time: "), _s(F.pmod(c, F.lit(997))),
                       F.lit(" s")))
        .when(et == "purchase",
              F.concat(F.lit("  Reduce input records="), _s(c)))
        .when(sub == 0, F.concat(F.lit("Final Diff: "), _s(c), F.lit("E-7")))
        .when(sub == 1, F.lit("Final Diff: n/a"))
        .when(sub == 2, F.concat(F.lit("Global Diff: "), _s(c)))
        .otherwise(F.concat(F.lit("Reduce task attempt_"), _s(F.col("event_id")),
                            F.lit(" SUCCEEDED")))
    )
    return ev.select("job_id", "algo", F.col("event_id").alias("pos"), line.alias("value"))


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, algorithm, dataset, total_time): wall time = sum of event values."""
    ev = _jobs(table(spark, sf_dir, "events"))
    return ev.groupBy("job_id", "algo", "dataset").agg(
        (F.sum("c") / F.lit(100.0)).alias("total_time")
    ).withColumnRenamed("algo", "algorithm")


def monitor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, pos, value): ``sar -u -r -n DEV`` text, one block per event.

    Odd events print 12-hour clock tokens (``AM``), even ones 24-hour clocks;
    view/click print a CPU block, signup/purchase a memory block, error an
    interface block with a loopback row.  Each job starts with a banner.
    """
    ev = _jobs(table(spark, sf_dir, "events"))
    c = F.col("c")
    clk = F.when(F.pmod("event_id", F.lit(2)) == 1, F.lit("12:00:01 AM")).otherwise(
        F.lit("00:00:01"))

    def row(*parts: Column) -> Column:
        return F.concat_ws("     ", clk, *parts)

    z = F.lit("0.00")
    cpu_hdr = row(F.lit("CPU"), F.lit("%user"), F.lit("%nice"), F.lit("%system"),
                  F.lit("%iowait"), F.lit("%steal"), F.lit("%idle"))
    cpu_row = row(F.lit("all"), fmt2(F.pmod(c, F.lit(5000))), z,
                  fmt2(F.pmod(c, F.lit(700))), fmt2(F.pmod(c, F.lit(300))), z,
                  fmt2(F.pmod(c * 7, F.lit(4000))))
    mem_hdr = row(*[F.lit(x) for x in ("kbmemfree", "kbavail", "kbmemused", "%memused",
                                       "kbbuffers", "kbcached", "kbcommit", "%commit",
                                       "kbactive", "kbinact", "kbdirty")])
    mem_row = row(_s(c * 10), _s(c * 11), _s(c * 1000), fmt2(F.pmod(c, F.lit(10000))),
                  _s(F.pmod(c * 3, F.lit(200000))), _s(c * 5), _s(c * 6), z, _s(c), _s(c),
                  _s(F.pmod(c, F.lit(90))))
    if_hdr = row(*[F.lit(x) for x in ("IFACE", "rxpck/s", "txpck/s", "rxkB/s", "txkB/s",
                                      "rxcmp/s", "txcmp/s", "rxmcst/s", "%ifutil")])
    lo_row = row(F.lit("lo"), fmt2(F.pmod(c, F.lit(900))), fmt2(F.pmod(c, F.lit(900))),
                 fmt2(c), fmt2(c), z, z, z, z)
    eth_row = row(F.lit("eth0"), fmt2(F.pmod(c, F.lit(300))), fmt2(F.pmod(c, F.lit(200))),
                  fmt2(F.pmod(c * 3, F.lit(50000))), fmt2(F.pmod(c * 2, F.lit(30000))),
                  z, z, z, z)
    et = F.col("event_type")
    lines = (
        F.when(et.isin("view", "click"), F.array(F.lit(""), cpu_hdr, cpu_row))
        .when(et.isin("signup", "purchase"), F.array(F.lit(""), mem_hdr, mem_row))
        .otherwise(F.array(F.lit(""), if_hdr, lo_row, eth_row))
    )
    blocks = ev.select("job_id", F.col("event_id"), F.posexplode(lines).alias("k", "value"))
    blocks = blocks.select("job_id", (F.col("event_id") * 10 + F.col("k") + 1).alias("pos"),
                           "value")
    banners = ev.groupBy("job_id").agg(F.min("event_id").alias("first")).select(
        "job_id", (F.col("first") * 10).alias("pos"),
        F.concat(F.lit("Linux 5.4.0 ("), F.col("job_id"),
                 F.lit(") \t01/02/2025 \t_x86_64_\t(4 CPU)")).alias("value"))
    return blocks.unionByName(banners)


# -------------------------------------------------------------- metrics

def metrics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value string): one metrics CSV row (with unit suffixes) per order."""
    o = table(spark, sf_dir, "orders")
    c = F.round("o_totalprice").cast("bigint")
    algo = (F.when(F.col("o_orderstatus") == "F", F.lit("giraph"))
            .when(F.col("o_orderstatus") == "O", F.lit("mapreduce"))
            .otherwise(F.lit("spark")))
    ds = F.lower(F.substring_index(F.col("o_orderpriority"), "-", -1))
    ds = F.regexp_replace(ds, " ", "_")
    job = F.concat(algo, F.lit("_"), ds, F.lit("_"), _s(F.col("o_orderkey")))
    line = F.concat_ws(
        ",", algo, ds, job,
        F.concat(fmt2(c), F.lit("s")),
        F.concat(fmt2(F.floor(c / 40)), F.lit("s")),
        F.concat(fmt2(F.pmod(c * 3, F.lit(100000))), F.lit("MB")),
        F.concat(fmt2(F.pmod(c, F.lit(500))), F.lit("GB")),
        _s(F.pmod(c, F.lit(100)) + 1),
        F.concat(F.lit("0.0000"), _s(F.pmod(c, F.lit(90)) + 10)),
        F.concat(fmt2(F.pmod(c, F.lit(10000))), F.lit("%")),
    )
    return o.select(line.alias("value"))


def metrics_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, value): headed metrics CSV text in two files of different header
    variants: orders of status 'P' write the older variant (9th column
    ``convergence_rate`` as a percentage), the others the newer one
    (``final_diff``)."""
    o = table(spark, sf_dir, "orders")
    c = F.round("o_totalprice").cast("bigint")
    old = F.col("o_orderstatus") == "P"
    fname = F.when(old, F.lit("metrics_old.csv")).otherwise(F.lit("metrics_new.csv"))
    ninth = F.when(old, F.concat(fmt2(F.pmod(c, F.lit(10000))), F.lit("%"))).otherwise(
        F.concat(F.lit("0.0000"), _s(F.pmod(c, F.lit(90)) + 10)))
    algo = F.when(old, F.lit("spark")).otherwise(
        F.when(F.col("o_orderstatus") == "F", F.lit("giraph")).otherwise(F.lit("mapreduce")))
    ds = F.regexp_replace(F.lower(F.substring_index(F.col("o_orderpriority"), "-", -1)),
                          " ", "_")
    row = F.concat_ws(
        ",", algo, ds, F.concat(algo, F.lit("_"), ds, F.lit("_"), _s(F.col("o_orderkey"))),
        F.concat(fmt2(c), F.lit("s")), F.concat(fmt2(F.floor(c / 40)), F.lit("s")),
        F.concat(fmt2(F.pmod(c * 3, F.lit(100000))), F.lit("MB")),
        F.concat(fmt2(F.pmod(c, F.lit(500))), F.lit("GB")),
        _s(F.pmod(c, F.lit(100)) + 1), ninth,
        F.concat(fmt2(F.pmod(c * 7, F.lit(10000))), F.lit("%")))
    rows = o.select(fname.alias("file"), row.alias("value"))
    header = F.concat_ws(",", *[F.lit(x) for x in RAW_COLUMNS[:8]],
                         F.when(F.col("file") == "metrics_old.csv", F.lit("convergence_rate"))
                         .otherwise(F.lit("final_diff")), F.lit(RAW_COLUMNS[9]))
    # every file has its header twice, as files do that were put together
    heads = rows.select("file").distinct().select("file", header.alias("value"))
    return rows.unionByName(heads).unionByName(heads)


def dataset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, ord, file, edges): the dataset dimension of the metrics rows.

    ``ord`` is the leading digit of the priority, ``edges`` 1000 x the number
    of orders of that priority.
    """
    o = table(spark, sf_dir, "orders")
    ds = F.regexp_replace(F.lower(F.substring_index(F.col("o_orderpriority"), "-", -1)),
                          " ", "_")
    return o.groupBy(ds.alias("dataset"),
                     F.substring("o_orderpriority", 1, 1).cast("int").alias("ord")).agg(
        (F.count(F.lit(1)) * 1000).alias("edges")
    ).select("dataset", "ord", F.concat(F.col("dataset"), F.lit(".txt")).alias("file"),
             "edges")
