"""Text sinks: adjacency TSV, vertex JSON, rank text, metrics CSV rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _str_list(c: str):
    return F.transform(F.col(c), lambda x: x.cast("string"))


def to_adjacency_tsv(adj: DataFrame, rank: float | str = 1.0) -> DataFrame:
    """(value): ``id\\t1.0\\tn1,n2``; empty third field for sinks (K1).
    ``rank``: the same for all, or the name of a column."""
    ranks = F.col(rank).cast("string") if isinstance(rank, str) else F.lit(repr(float(rank)))
    return adj.select(F.concat_ws("\t", F.col("id").cast("string"), ranks,
                                  F.array_join(_str_list("nbrs"), ",")).alias("value"))


def to_vertex_json(adj: DataFrame, value: float = 1.0, style: str = "compact") -> DataFrame:
    """(value): ``[id,1.0,[[n,0],...]]`` per vertex (K2).

    ``style='compact'`` writes no blanks; ``style='python'`` writes the
    ``json.dumps`` spacing ``[1, 1.0, [[2, 0], [3, 0]]]`` and casts ids to
    integers (ids that are not integers become null there).  Neighbours may
    be structs (dst, weight); plain ones have weight 0.
    """
    if style not in ("compact", "python"):
        raise ValueError("style must be 'compact' or 'python'")
    sep = ", " if style == "python" else ","

    def ident(c):
        return c.try_cast("bigint").cast("string") if style == "python" else c.cast("string")
    weighted = isinstance(adj.schema["nbrs"].dataType.elementType, T.StructType)

    def pair(x):
        dst, weight = (x["dst"], x["weight"].cast("string")) if weighted else (x, F.lit("0"))
        return F.concat(F.lit("["), ident(dst), F.lit(sep), weight, F.lit("]"))
    pairs = F.transform(F.col("nbrs"), pair)
    return adj.select(F.concat(F.lit("["), ident(F.col("id")),
                               F.lit(sep + repr(float(value)) + sep + "["),
                               F.array_join(pairs, sep), F.lit("]]")).alias("value"))


def _in_order(adj: DataFrame) -> DataFrame:
    """Parts of a vertex (``adjacency_parts``) next to each other and in
    order; a vertex of many parts may go on in the next file."""
    if "part" not in adj.columns:
        return adj
    return adj.repartitionByRange("id", "part").sortWithinPartitions("id", "part")


def write_adjacency_tsv(adj: DataFrame, path: str, rank: float = 1.0) -> None:
    """Write K1 lines as text files (fails if the folder exists).  Of rows
    with a ``part`` each part is a line that starts with the vertex, so no
    line grows with a hot vertex; a vertex of one part has the line it has
    in K1.  The readers here take several lines of a vertex together."""
    to_adjacency_tsv(_in_order(adj), rank).write.mode("errorifexists").text(path)


def write_vertex_json(adj: DataFrame, path: str, style: str = "compact") -> None:
    """Write K2 lines as text files (fails if the folder exists); parts as in
    ``write_adjacency_tsv``."""
    to_vertex_json(_in_order(adj), style=style).write.mode("errorifexists").text(path)


def rank_lines(ranks: DataFrame) -> DataFrame:
    """(value): ``id\\tvalue`` per vertex (K3 text form)."""
    return ranks.select(F.concat_ws("\t", F.col("id").cast("string"),
                                    F.col("rank").cast("string")).alias("value"))


def write_ranks(ranks: DataFrame, path: str, fmt: str = "text") -> None:
    """Write ranks as ``id\\tvalue`` text or parquet (K3)."""
    if fmt == "text":
        rank_lines(ranks).write.mode("errorifexists").text(path)
    else:
        ranks.write.mode("errorifexists").parquet(path)


def write_log_lines(lines: DataFrame, path: str) -> None:
    """Write log lines (job_id, pos, value) as one folder of parts per job,
    ``<path>/job=<job_id>.log``, in the order of ``pos``.  The rows are
    range-partitioned by (job_id, pos), so a long log has several parts and
    no task holds a whole one; ``read_log_lines`` gives the order back."""
    rows = lines.select(F.concat("job_id", F.lit(".log")).alias("job"), "pos", "value")
    rows.repartitionByRange("job", "pos").sortWithinPartitions("job", "pos").drop("pos") \
        .write.partitionBy("job").mode("errorifexists").text(path)


# The columns of a metrics row and the format of each.
METRICS_FORMATS = {
    "algorithm": "%s", "dataset": "%s", "job_id": "%s", "total_execution_time": "%.2fs",
    "avg_iteration_time": "%.2fs", "network_communication": "%.2fMB",
    "peak_memory_usage": "%.2fGB", "iterations_to_converge": "%d", "final_diff": "%.6f",
    "cpu_utilization": "%.2f%%",
}


def format_metrics(m: DataFrame) -> DataFrame:
    """(value): one CSV row per job in the metrics-row format (K5)."""
    return m.select(F.format_string(",".join(METRICS_FORMATS.values()), *METRICS_FORMATS).alias("value"))


def append_metrics(m: DataFrame, path: str) -> None:
    """Append rows in the metrics-row format to a folder of CSV files, each
    with the header line (K5 append)."""
    rows = m.select(*[F.format_string(f, c).alias(c) for c, f in METRICS_FORMATS.items()])
    rows.write.mode("append").option("header", True).csv(path)
