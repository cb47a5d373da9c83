"""Benchmark statistics over metrics rows.

The metrics table has one row per job (it grows with the number of runs);
everything here is one aggregate by (dataset, algorithm) followed by work on
that small result: conditional aggregation instead of a pivot job, a join
with the dataset dimension, and a ``lag`` window for the scaling slopes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import safe_ratio, strip_units, try_double
from ..sinks import METRICS_FORMATS

# The columns that carry unit suffixes and are cleaned (B1),
# and the four averaged metrics (B2).
UNIT_COLUMNS = ("total_execution_time", "avg_iteration_time", "network_communication",
                "peak_memory_usage", "cpu_utilization")
AVERAGED = ("total_execution_time", "avg_iteration_time", "network_communication",
            "peak_memory_usage")
RAW_COLUMNS = tuple(METRICS_FORMATS)
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


def read_metrics_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """metrics_raw, all strings, from headed CSV files, folders or globs.

    One text read; see ``parse_metrics_text`` for the header variants.
    """
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("pos"))
    return parse_metrics_text(lines, pos="pos")


# Every header variant has these columns at most (the older one has
# ``convergence_rate`` in place of ``final_diff``).
READ_COLUMNS = (*RAW_COLUMNS, "convergence_rate")


def parse_metrics_text(lines: DataFrame, value: str = "value", file: str = "file",
                       pos: str | None = None) -> DataFrame:
    """metrics_raw (all strings) from CSV text lines tagged with their file.

    The header of a file is its first header line (the smallest ``pos``, or
    the smallest text without one); header lines are never data, also not
    repeated ones.  Every data line is cut once by ``from_csv``, and its
    fields get the names of its file's header, so all variants are read in
    one pass.  The header table has one row per file, as the listing of the
    files has, and is broadcast.
    """
    lines = lines.select(F.col(value).alias("value"), F.col(file).alias("file"),
                         (F.col(pos) if pos else F.col(value)).alias("pos"))
    is_head = F.col("value").startswith("algorithm,")
    heads = lines.where(is_head).groupBy("file").agg(F.min_by("value", "pos").alias("header"))
    width = len(RAW_COLUMNS)
    fields = F.from_csv("value", ", ".join(f"c{i} STRING" for i in range(width)))
    data = (lines.where(~is_head & (F.length(F.trim("value")) > 0)).join(F.broadcast(heads), "file")
            .select(fields.alias("f"), F.slice(F.split("header", ","), 1, width).alias("names"))
            .select(F.array(*[F.col(f"f.c{i}") for i in range(width)]).alias("f"), "names"))
    return data.select(*[F.try_element_at("f", F.nullif(F.array_position("names", c), F.lit(0).cast("bigint"))
                                          .cast("int")).alias(c) for c in READ_COLUMNS])


def parse_metrics_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """metrics_raw (all strings) from header-less CSV text rows."""
    return lines.select(F.from_csv(F.col(value), RAW_SCHEMA.simpleString()).alias("r")).select("r.*")


def typed_metrics(raw: DataFrame) -> DataFrame:
    """Unit columns cleaned to doubles (0.0 when unparsable), the rest typed (B1)."""
    cols = [F.col("algorithm"), F.col("dataset"), F.col("job_id")]
    for c in UNIT_COLUMNS:
        cols.append(strip_units(c).alias(c))
    cols.append(F.col("iterations_to_converge").try_cast("int").alias("iterations_to_converge"))
    if "final_diff" in raw.columns:
        cols.append(try_double("final_diff").alias("final_diff"))
    if "convergence_rate" in raw.columns:
        # only the older header variant has it: null for the other rows
        cr = F.col("convergence_rate")
        cols.append(F.when(cr.isNotNull(), strip_units(cr)).alias("convergence_rate"))
    return raw.select(*cols)


def group_mean(m: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys..., runs, mean of each col) by the given keys (A5)."""
    return m.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"),
                                *[F.avg(c).alias(c) for c in cols])


def average_metrics(m: DataFrame) -> DataFrame:
    """(dataset, algorithm, runs, <4 means>) (B2)."""
    return group_mean(m, ["dataset", "algorithm"], list(AVERAGED))


def normalized_iter_time(avg: DataFrame, dim: DataFrame) -> DataFrame:
    """(dataset, algorithm, edges, avg_iteration_time, time_per_m_edges).

    Seconds per iteration and per million edges; the dimension joins on dataset.
    """
    return avg.join(dim.select("dataset", "edges"), "dataset").select(
        "dataset", "algorithm", "edges", "avg_iteration_time",
        (F.col("avg_iteration_time") / (F.col("edges") / F.lit(1e6))).alias("time_per_m_edges"))


def _side_by_side(avg: DataFrame, a: str, b: str) -> DataFrame:
    """One row per dataset with both algorithms' means (P8: datasets with both only)."""
    if a == b:
        raise ValueError("compare two different algorithms")
    def pick(alg: str, c: str):
        return F.max(F.when(F.col("algorithm") == alg, F.col(c))).alias(f"{alg}__{c}")
    g = avg.where(F.col("algorithm").isin(a, b)).groupBy("dataset").agg(
        F.count_if(F.col("algorithm") == a).alias("_na"),
        F.count_if(F.col("algorithm") == b).alias("_nb"),
        *[pick(alg, c) for alg in (a, b) for c in AVERAGED])
    return g.where((F.col("_na") > 0) & (F.col("_nb") > 0))


def metric_ratios(avg: DataFrame, num: str = "mapreduce", den: str = "giraph") -> DataFrame:
    """(dataset, time_ratio, iter_ratio, network_ratio, memory_ratio) = num / den.

    The network ratio is 0 when the denominator is not positive; the others
    are null (not an error) on a zero denominator.
    """
    s = _side_by_side(avg, num, den)

    def r(c: str):
        return F.try_divide(F.col(f"{num}__{c}"), F.col(f"{den}__{c}"))
    return s.select(
        "dataset",
        r("total_execution_time").alias("time_ratio"),
        r("avg_iteration_time").alias("iter_ratio"),
        safe_ratio(F.col(f"{num}__network_communication"),
                   F.col(f"{den}__network_communication")).alias("network_ratio"),
        r("peak_memory_usage").alias("memory_ratio"))


def memory_speedup(avg: DataFrame, a: str = "giraph", b: str = "mapreduce") -> DataFrame:
    """(dataset, mem_ratio = a.mem / b.mem, speedup = b.time / a.time)."""
    s = _side_by_side(avg, a, b)
    return s.select(
        "dataset",
        F.try_divide(F.col(f"{a}__peak_memory_usage"), F.col(f"{b}__peak_memory_usage"))
        .alias("mem_ratio"),
        F.try_divide(F.col(f"{b}__total_execution_time"), F.col(f"{a}__total_execution_time"))
        .alias("speedup"))


def scaling_exponent(avg: DataFrame, dim: DataFrame) -> DataFrame:
    """(algorithm, dataset, ord, edges, time, slope).

    slope = (ln time - ln previous time) / (ln edges - ln previous edges),
    previous = the dataset before it in presentation order for the same
    algorithm; null for the first dataset and for equal edge counts.
    """
    j = avg.join(dim.select("dataset", "ord", "edges"), "dataset").select(
        "algorithm", "dataset", "ord", "edges",
        F.col("total_execution_time").alias("time"))
    w = Window.partitionBy("algorithm").orderBy("ord")
    pe, pt = F.lag("edges").over(w), F.lag("time").over(w)
    dl = F.ln(F.col("edges")) - F.ln(pe)
    return j.select("algorithm", "dataset", "ord", "edges", "time",
                    F.when(pe.isNotNull() & (dl != 0),
                           (F.ln(F.col("time")) - F.ln(pt)) / dl).alias("slope"))


def presentation_order(df: DataFrame, dim: DataFrame, *then: str) -> DataFrame:
    """Sort rows by the dataset's presentation order, then by ``then`` (O1)."""
    return df.join(dim.select("dataset", "ord"), "dataset", "left").orderBy("ord", *then)


def dataset_dim(spark: SparkSession, rows: list[tuple[str, int, str, int]]) -> DataFrame:
    """(dataset, ord, file, edges) from explicit rows."""
    schema = "dataset string, ord int, file string, edges bigint"
    return spark.createDataFrame(rows, schema)
