"""Job-log and ``sar`` monitor-log parsing (S5, S6, S9) into tidy rows.

Input everywhere: log lines ``(job_id, algo, pos, value)`` where ``pos``
orders the lines of one job.  Parsing is row-local (no shuffle); the per-job
metrics are partial + final aggregates in ``operators.telemetry``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (capture_number, java_trim, last_position, split_ws, token,
                         try_double)

# The superstep pattern of the BSP rule (on the lower-cased
# line); the line labels the job-log rules look for; the monitor-log
# tokens and skipped-line markers.
SUPERSTEP_PATTERN = r"superstep\s*[:=]?\s*(-?\d+)"
FINAL_LABEL, TOTAL_LABEL, ANY_LABEL = "Final Diff:", "Total Diff:", "Diff:"
SUCCESS_TEXT = "completed successfully"
SKIPPED_MARKERS = ("Linux", "Average", "IFACE")
CLOCK_TOKENS = ("AM", "PM")


def read_log_lines(spark: SparkSession, pattern: str, algo: str | None = None) -> DataFrame:
    """(job_id, algo, pos, value) from log files ``<algo>_<dataset>_<run>[_mon].log``,
    or folders of that name that hold a log in parts (``sinks.write_log_lines``) (S9).

    Files are read line by line and split like any text input, so a huge log
    is spread over many tasks.  ``pos`` is exact line order within a log: the
    part's name (empty for a log in one file), the split's byte offset
    (``_metadata.file_block_start``), then the row order inside the split.
    """
    # paths come URL-encoded ('{' -> %7B); keep a literal '+' as is
    path = F.try_url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    raw = spark.read.option("recursiveFileLookup", True).text(pattern).select(
        "value", path.alias("f"), F.col("_metadata.file_name").alias("part"),
        F.col("_metadata.file_block_start").alias("blk"))
    name = F.regexp_extract("f", r"(?:^|/)(?:job=)?([^/]+?)(?:_mon|_full)?\.log(?:/[^/]*)?$", 1)
    algo_col = F.lit(algo) if algo else F.regexp_extract(name, r"^([^_]+)_", 1)
    return raw.select(
        name.alias("job_id"), algo_col.alias("algo"),
        F.struct(F.when(F.col("f").endswith(".log"), "").otherwise(F.col("part")).alias("part"),
                 F.col("blk").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("pos"),
        F.regexp_replace("value", "\r$", "").alias("value"))


read_log_dir = read_log_lines   # the survey's name for S9


def parse_job_log(lines: DataFrame) -> DataFrame:
    """Per line: (job_id, algo, pos, final_diff, total_diff, any_diff, cand_diff,
    superstep, success) (S6).

    * ``final_diff``: number after ``Final Diff:`` (null if no number).
    * ``total_diff``: number after ``Total Diff:`` on lines without ``Final Diff:``.
    * ``any_diff``: number of the first ``Diff:`` match (batch jobs only use it).
    * ``cand_diff``: the fallback candidate: total_diff for BSP jobs
      (algo 'giraph'), any_diff else total_diff for batch jobs.
    * ``superstep``: BSP rule - the lower-cased line contains 'superstep' and
      'finish' or 'completed'; first ``superstep[:=]? <int>`` match.
    * ``success``: the line contains 'completed successfully'.
    """
    v = F.col("value")
    low = F.lower(v)
    has_final = v.contains(FINAL_LABEL)
    final_diff = F.when(has_final, capture_number(v, FINAL_LABEL))
    total_diff = F.when(~has_final & v.contains(TOTAL_LABEL),
                        capture_number(v, TOTAL_LABEL))
    any_diff = F.when(v.contains(ANY_LABEL), capture_number(v, ANY_LABEL))
    is_bsp = F.col("algo") == "giraph"
    step_line = low.contains("superstep") & (low.contains("finish") | low.contains("completed"))
    step = F.when(is_bsp & step_line,
                  F.nullif(F.regexp_extract(low, SUPERSTEP_PATTERN, 1), F.lit(""))
                  .try_cast("int"))
    return lines.select(
        "job_id", "algo", "pos", "value",
        final_diff.alias("final_diff"), total_diff.alias("total_diff"),
        any_diff.alias("any_diff"),
        F.when(is_bsp, total_diff).otherwise(F.coalesce(any_diff, total_diff))
        .alias("cand_diff"),
        step.alias("superstep"),
        v.contains(SUCCESS_TEXT).alias("success"))


def parse_sar(lines: DataFrame) -> DataFrame:
    """Tidy samples from ``sar -u -r -n DEV`` text.

    Skips blank lines and lines containing 'Linux', 'Average' or 'IFACE'.
    Tokens: trim + split on blanks; a 12-hour clock adds an AM/PM token, so
    values start at token v = 2, else v = 1.  Columns (null when the rule
    does not apply, as in the reference's silent parse failures):

    * cpu_user, cpu_system: tokens after the LAST 'all' (+1 and +3).
    * kbmemused: token v+2 of rows without 'all' and without 'CPU'
      (as coded, interface rows are tested too).
    * iface, rx_kb_s, tx_kb_s: interface rows (token v not a number).
    * compat_a, compat_b: tokens v+3, v+4 of every non-'CPU', non-'lo' row
      with more than v+5 tokens (the as-coded network rule).
    """
    v = F.col("value")
    skip = java_blank(v)
    for marker in SKIPPED_MARKERS:
        skip = skip | v.contains(marker)
    keep = ~skip
    t = lines.where(keep).select("job_id", "pos", v.alias("line"), split_ws(v).alias("p"))
    n = F.size("p")
    vs = F.when((n > 1) & token("p", 1).isin(*CLOCK_TOKENS), F.lit(2)).otherwise(F.lit(1))
    t = t.withColumn("v", vs).withColumn("ai", last_position("p", "all") - 1)
    has_cpu = F.col("line").contains("CPU")
    ai, vv = F.col("ai"), F.col("v")
    cpu_ok = (ai >= 0) & (n > ai + 3)
    user = try_double(token("p", ai + 1))
    system = try_double(token("p", ai + 3))
    both = cpu_ok & user.isNotNull() & system.isNotNull()
    mem_ok = (ai < 0) & ~has_cpu & (n > vv + 2)
    first_val = token("p", vv)
    net_ok = ~has_cpu & (n > vv + 5) & (first_val != "lo")
    a, b = try_double(token("p", vv + 3)), try_double(token("p", vv + 4))
    net_both = net_ok & a.isNotNull() & b.isNotNull()
    is_iface = (ai < 0) & ~has_cpu & (n > vv + 5) & try_double(first_val).isNull()
    kind = (F.when(ai >= 0, F.lit("cpu")).when(is_iface, F.lit("iface"))
            .when(mem_ok, F.lit("mem")).otherwise(F.lit("other")))
    return t.select(
        "job_id", "pos", kind.alias("kind"),
        F.when(both, user).alias("cpu_user"), F.when(both, system).alias("cpu_system"),
        F.when(mem_ok, try_double(token("p", vv + 2))).alias("kbmemused"),
        F.when(is_iface, first_val).alias("iface"),
        F.when(is_iface, a).alias("rx_kb_s"), F.when(is_iface, b).alias("tx_kb_s"),
        F.when(net_both, a).alias("compat_a"), F.when(net_both, b).alias("compat_b"))


def java_blank(c) -> F.Column:
    """True when the line is empty after a Java-style trim."""
    return java_trim(c) == ""
