"""Per-job telemetry from parsed logs (T1-T14): one row per job, many jobs at once.

All per-job results are ``groupBy(job_id)`` with partial + final aggregates
(avg, max, count, max_by), so a job with a huge log is combined map-side and
never collected into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import split_ws, token, try_double

MB = 1048576.0
# Line labels of the collect-metrics rules (T10-T12) and the
# assumed bytes per shuffled record.
BYTES_SENT_LABEL = "Bytes sent"
MEMORY_USED_LABEL = "Memory Used"
MAP_RECORDS_LABEL = "Map input records"
REDUCE_RECORDS_LABEL = "Reduce input records"
BYTES_PER_RECORD = 100


def exact_avg(c: Column) -> Column:
    """Mean over an exact decimal sum, so the result does not depend on how
    the rows are split over tasks (a double sum does, in its last bits)."""
    return F.avg(c.cast("decimal(38,10)")).cast("double")


def _last(value: Column, pos: str = "pos") -> Column:
    """Value of the last line (by pos) where value is not null."""
    return F.max_by(value, F.when(value.isNotNull(), F.col(pos)))


# ------------------------------------------------------------ monitor logs

def cpu_util(samples: DataFrame) -> DataFrame:
    """(job_id, cpu_utilization): mean %user + %system of 'all' rows, 0 if none."""
    return samples.groupBy("job_id").agg(
        F.coalesce(exact_avg(F.col("cpu_user") + F.col("cpu_system")), F.lit(0.0))
        .alias("cpu_utilization"))


def peak_mem_gb(samples: DataFrame) -> DataFrame:
    """(job_id, peak_memory_usage): max kbmemused above 1024 / 1024^2, 0 if none."""
    kb = F.when(F.col("kbmemused") > 1024, F.col("kbmemused"))
    return samples.groupBy("job_id").agg(
        F.coalesce(F.max(kb) / F.lit(1024.0 * 1024.0), F.lit(0.0)).alias("peak_memory_usage"))


def _with_time(rates: DataFrame, runs: DataFrame, name: str) -> DataFrame:
    return runs.select("job_id", "total_time").join(rates, "job_id", "left").select(
        "job_id", (F.coalesce("rate", F.lit(0.0)) * F.col("total_time") / F.lit(1024.0))
        .alias(name))


def network_mb(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """(job_id, network_communication): mean rx+tx kB/s of non-loopback
    interface rows x total time / 1024 (T3a, the intended rule)."""
    rate = F.when((F.col("kind") == "iface") & (F.col("iface") != "lo"),
                  F.col("rx_kb_s") + F.col("tx_kb_s"))
    rates = samples.groupBy("job_id").agg(exact_avg(rate).alias("rate"))
    return _with_time(rates, runs, "network_communication")


def network_mb_compat(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """(job_id, network_communication): the as-coded rule, which also averages
    CPU and memory rows (T3b; reproduces the published column)."""
    rates = samples.groupBy("job_id").agg(
        exact_avg(F.col("compat_a") + F.col("compat_b")).alias("rate"))
    return _with_time(rates, runs, "network_communication")


# ---------------------------------------------------------------- job logs

def iterations(parsed: DataFrame) -> DataFrame:
    """(job_id, iterations_to_converge) (T4 for algo 'giraph', T5 otherwise).

    BSP: the largest superstep number on finish lines, floor 0; batch: the
    number of 'completed successfully' lines; 0 becomes 1 in both.
    """
    bsp = F.bool_or(F.col("algo") == "giraph")
    return parsed.groupBy("job_id").agg(
        bsp.alias("bsp"),
        F.max("superstep").alias("mx"),
        F.count_if(F.col("success")).alias("ok"),
    ).select("job_id", F.greatest(
        F.when(F.col("bsp"), F.coalesce("mx", F.lit(0))).otherwise(F.col("ok")),
        F.lit(1)).cast("int").alias("iterations_to_converge"))


def final_diff(parsed: DataFrame) -> DataFrame:
    """(job_id, final_diff): last 'Final Diff:' value; else the last fallback
    candidate (Total Diff for BSP jobs, any Diff for batch jobs); else 0 (T6)."""
    return parsed.groupBy("job_id").agg(
        F.coalesce(_last(F.col("final_diff")), _last(F.col("cand_diff")), F.lit(0.0))
        .alias("final_diff"))


def convergence_rate(initial: Column | float, final: Column | float,
                     iters: Column | int) -> Column:
    """100 * (initial - final) / (iterations * initial); null if the divisor is 0."""
    i = initial if isinstance(initial, Column) else F.lit(float(initial))
    f = final if isinstance(final, Column) else F.lit(float(final))
    n = iters if isinstance(iters, Column) else F.lit(iters)
    return F.lit(100.0) * (i - f) / F.nullif(n * i, F.lit(0.0))


def bytes_sent_mb(lines: DataFrame) -> DataFrame:
    """(job_id, bytes_sent_mb): sum of the 3rd token of 'Bytes sent' lines / 2^20."""
    v = F.when(F.col("value").contains(BYTES_SENT_LABEL),
               F.coalesce(try_double(token(split_ws("value"), 2)), F.lit(0.0)))
    return lines.groupBy("job_id").agg(
        (F.coalesce(F.sum(v), F.lit(0.0)) / F.lit(MB)).alias("bytes_sent_mb"))


def shuffle_mb_estimate(lines: DataFrame, bytes_per_record: int = BYTES_PER_RECORD) -> DataFrame:
    """(job_id, shuffle_mb): (map input + reduce input records) x 100 B / 2^20.

    The record counts are the numbers after 'Map input records' and 'Reduce
    input records' (``=`` or ``:`` separated).
    """
    def rec(label: str) -> Column:
        return try_double(F.regexp_extract("value", label + r"\s*[=:]?\s*(\d+)", 1))
    recs = F.coalesce(rec(MAP_RECORDS_LABEL), F.lit(0.0)) + F.coalesce(
        rec(REDUCE_RECORDS_LABEL), F.lit(0.0))
    return lines.groupBy("job_id").agg(
        (F.sum(recs) * F.lit(float(bytes_per_record)) / F.lit(MB)).alias("shuffle_mb"))


def max_memory_gb(lines: DataFrame) -> DataFrame:
    """(job_id, max_memory_gb): largest 3rd token of 'Memory Used' lines / 1024."""
    v = F.when(F.col("value").contains(MEMORY_USED_LABEL),
               F.coalesce(try_double(token(split_ws("value"), 2)), F.lit(0.0)))
    return lines.groupBy("job_id").agg(
        F.coalesce(F.max(v) / F.lit(1024.0), F.lit(0.0)).alias("max_memory_gb"))


def log_value(lines: DataFrame, label: str, field: int, scale: float = 1.0,
              name: str = "value") -> DataFrame:
    """(job_id, name): 1-based whitespace field of the LAST line containing
    ``label``, divided by ``scale``; 0 when absent or not a number (T13)."""
    v = F.when(F.col("value").contains(label),
               F.coalesce(try_double(token(split_ws("value"), field - 1)), F.lit(0.0)))
    return lines.groupBy("job_id").agg(
        F.coalesce(_last(v) / F.lit(float(scale)), F.lit(0.0)).alias(name))


def count_lines(lines: DataFrame, *patterns: str, name: str = "n") -> DataFrame:
    """(job_id, name): number of lines containing every pattern."""
    cond = F.lit(True)
    for p in patterns:
        cond = cond & F.col("value").contains(p)
    return lines.groupBy("job_id").agg(F.count_if(cond).cast("bigint").alias(name))


def collected_metrics(lines: DataFrame) -> DataFrame:
    """One row per job as the collection script writes it, plus the mean
    superstep time, in a single aggregate over the log lines.

    ``lines`` is (job_id, algo, pos, value).  BSP jobs: seconds are the fifth
    field of the last 'Total execution time' line, iterations the 'Superstep'
    lines, network the 'Bytes sent' bytes, superstep time the mean fifth
    field of 'Superstep' lines.  Batch jobs: the fourth field of the last
    'Run time' line in ms, 'Reduce ... SUCCEEDED' lines, 100 bytes per input
    record.  Without iterations the per-iteration values are null.
    """
    text = F.col("value")
    fields = split_ws("value")

    def num(i: int) -> Column:
        return F.coalesce(try_double(token(fields, i)), F.lit(0.0))

    def rec(label: str) -> Column:
        return F.coalesce(try_double(F.regexp_extract("value", label + r"\s*[=:]?\s*(\d+)", 1)), F.lit(0.0))
    step = text.contains("Superstep")
    g = lines.groupBy("job_id").agg(
        F.bool_or(F.col("algo") == "giraph").alias("bsp"),
        _last(F.when(text.contains("Total execution time"), num(4))).alias("bsp_s"),
        (_last(F.when(text.contains("Run time"), num(3))) / 1000).alias("batch_s"),
        F.count_if(step).alias("steps"),
        F.count_if(text.contains("Reduce") & text.contains("SUCCEEDED")).alias("reduces"),
        F.sum(F.when(text.contains(BYTES_SENT_LABEL), num(2)).otherwise(0.0)).alias("sent"),
        (F.sum(rec(MAP_RECORDS_LABEL) + rec(REDUCE_RECORDS_LABEL)) * float(BYTES_PER_RECORD)).alias("records"),
        F.max(F.when(text.contains(MEMORY_USED_LABEL), num(2))).alias("memory"),
        F.avg(F.when(step, num(4))).alias("superstep_time"))

    def either(a: str, b: str) -> Column:
        return F.when(F.col("bsp"), F.col(a)).otherwise(F.col(b))
    n = either("steps", "reduces")
    time = F.coalesce(either("bsp_s", "batch_s"), F.lit(0.0))
    return g.select(
        F.when(F.col("bsp"), F.lit("giraph")).otherwise(F.lit("mapreduce")).alias("algorithm"), "job_id",
        time.alias("total_execution_time"), F.try_divide(time, n).alias("avg_iteration_time"),
        (either("sent", "records") / F.lit(MB)).alias("network_communication"),
        (F.coalesce("memory", F.lit(0.0)) / 1024).alias("peak_memory_usage"),
        n.cast("bigint").alias("iterations_to_converge"),
        convergence_rate(1.0, 0.0001, n).alias("convergence_rate"),
        F.when(F.col("bsp"), F.col("superstep_time")).alias("mean_superstep_time"))


# ------------------------------------------------------------------ join

def monitor_summary(samples: DataFrame) -> DataFrame:
    """(job_id, cpu_utilization, peak_memory_usage, iface_rate, compat_rate) in one pass."""
    kb = F.when(F.col("kbmemused") > 1024, F.col("kbmemused"))
    iface = F.when((F.col("kind") == "iface") & (F.col("iface") != "lo"),
                   F.col("rx_kb_s") + F.col("tx_kb_s"))
    return samples.groupBy("job_id").agg(
        exact_avg(F.col("cpu_user") + F.col("cpu_system")).alias("cpu_utilization"),
        (F.max(kb) / F.lit(1024.0 * 1024.0)).alias("peak_memory_usage"),
        exact_avg(iface).alias("iface_rate"),
        exact_avg(F.col("compat_a") + F.col("compat_b")).alias("compat_rate"))


def log_summary(parsed: DataFrame) -> DataFrame:
    """(job_id, iterations_to_converge, final_diff) in one pass (T4/T5 + T6)."""
    g = parsed.groupBy("job_id").agg(
        F.bool_or(F.col("algo") == "giraph").alias("bsp"),
        F.max("superstep").alias("mx"), F.count_if(F.col("success")).alias("ok"),
        F.coalesce(_last(F.col("final_diff")), _last(F.col("cand_diff")), F.lit(0.0))
        .alias("final_diff"))
    return g.select("job_id", F.greatest(
        F.when(F.col("bsp"), F.coalesce("mx", F.lit(0))).otherwise(F.col("ok")),
        F.lit(1)).cast("int").alias("iterations_to_converge"), "final_diff")


def job_metrics(parsed: DataFrame, samples: DataFrame, runs: DataFrame,
                network: str = "interface") -> DataFrame:
    """One typed metrics row per job of ``runs`` (T8, with T7 = time / iterations).

    ``runs``: (job_id, algorithm, dataset, total_time).  Jobs without log or
    monitor lines get the reference's defaults (1 iteration, zeros).
    ``network``: 'interface' (T3a) or 'as_coded' (T3b).  One aggregate over
    the log lines, one over the samples, then joins on job_id.
    """
    rate = "iface_rate" if network == "interface" else "compat_rate"
    m = (runs.join(log_summary(parsed), "job_id", "left")
         .join(monitor_summary(samples), "job_id", "left"))
    iters = F.coalesce("iterations_to_converge", F.lit(1))
    return m.select(
        "algorithm", "dataset", "job_id",
        F.col("total_time").alias("total_execution_time"),
        (F.col("total_time") / iters).alias("avg_iteration_time"),
        (F.coalesce(rate, F.lit(0.0)) * F.col("total_time") / F.lit(1024.0))
        .alias("network_communication"),
        F.coalesce("peak_memory_usage", F.lit(0.0)).alias("peak_memory_usage"),
        iters.cast("int").alias("iterations_to_converge"),
        F.coalesce("final_diff", F.lit(0.0)).alias("final_diff"),
        F.coalesce("cpu_utilization", F.lit(0.0)).alias("cpu_utilization"))
