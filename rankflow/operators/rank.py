"""One link-rank update on DataFrames.

Update rule: ``rank' = base + damping * sum(rank(u) / outdeg(u))`` over the
in-edges (u, v) of v; every parallel edge sends its own vote and counts in
``outdeg(u)``.  Unnormalised: a sink's rank is sent to nobody, a vertex
without in-edges gets ``base``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import FIXED_POINT_SCALE, exact_sum, fixed_point
from ..session import ensure_checkpoint_dir

# Damping and base of the update rule.
DAMPING = 0.85
BASE = 0.15


# Distinct out-neighbours of one source per join bucket, and the buckets that
# a hot source's edges are spread over while they are tagged.
SALT_CHUNK = 50_000
TAG_BUCKETS = 256


def hot_sources(fan: DataFrame, salt_chunk: int = SALT_CHUNK) -> DataFrame:
    """(src, nsalt) of the sources with more than ``salt_chunk`` distinct
    targets, from (src, fanout)."""
    return fan.where(F.col("fanout") > salt_chunk).select(
        "src", F.ceil(F.col("fanout") / F.lit(salt_chunk)).cast("int").alias("nsalt"))


def tag_salts(mult: DataFrame, hot: DataFrame, values: tuple[str, ...] = (),
              salt_chunk: int = SALT_CHUNK) -> DataFrame:
    """Adds ``nsalt`` and ``salt`` to (src, dst, values..., mult) rows; 1 and
    0 for sources that are not among the (src, nsalt) rows of ``hot``.

    The join that finds the hot sources is itself salted: edges go by
    (src, bucket of dst and values), and only the hot rows are repeated for
    the buckets.  Sources above a ``salt_chunk`` of TAG_BUCKETS or more are
    few and repeated for every bucket; below it they may be all vertices, and
    meet the buckets that their edges have.  Either way there are no more
    repeated rows than edges, and they are shuffled: their number is unknown
    to the planner, which would broadcast them.
    """
    bucket = F.pmod(F.xxhash64("dst", *values), F.lit(TAG_BUCKETS)).cast("int")
    hot = hot.select(F.col("src").alias("hot_src"), F.col("nsalt").alias("hot_nsalt"))
    if salt_chunk >= TAG_BUCKETS:
        hot = hot.withColumn("hot_bucket", F.explode(F.sequence(F.lit(0), F.lit(TAG_BUCKETS - 1))))
    else:
        used = mult.select(F.col("src").alias("hot_src"), bucket.alias("hot_bucket")).distinct()
        hot = used.join(hot.hint("merge"), "hot_src")
    tagged = mult.withColumn("bucket", bucket).join(
        hot.hint("merge"), (F.col("src") == F.col("hot_src")) & (F.col("bucket") == F.col("hot_bucket")), "left")
    nsalt = F.coalesce("hot_nsalt", F.lit(1))
    return tagged.select("src", "dst", *values, "mult", nsalt.alias("nsalt"),
                         F.pmod(F.xxhash64("dst", *values, F.lit(1)), nsalt).cast("int").alias("salt"))


def _votes(edges: DataFrame, ranks: DataFrame, salt_chunk: int) -> DataFrame:
    """(dst, mult, vote) per distinct edge; hot sources meet their votes in
    salted buckets, parallel edges are counted before anything moves.  The
    counted edges are checkpointed: fan-out, hot sources and votes read them,
    not the input."""
    ensure_checkpoint_dir(edges.sparkSession)
    mult = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("mult")).checkpoint(eager=True)
    fan = mult.groupBy("src").agg(F.sum("mult").alias("outdeg"), F.count(F.lit(1)).alias("fanout"))
    send = ranks.join(fan, ranks["id"] == fan["src"]).select(
        "src", (F.col("rank") / F.col("outdeg")).alias("vote"),
        F.explode(F.sequence(F.lit(0), F.greatest(
            F.ceil(F.col("fanout") / F.lit(salt_chunk)).cast("int"), F.lit(1)) - 1)).alias("salt"))
    return tag_salts(mult, hot_sources(fan, salt_chunk), salt_chunk=salt_chunk).join(send, ["src", "salt"]).select("dst", "mult", "vote")


def contributions(edges: DataFrame, ranks: DataFrame, salt_chunk: int = SALT_CHUNK) -> DataFrame:
    """(dst, vote): one vote rank/outdeg per out-edge.

    Vertices without out-edges send nothing: the inner join never divides
    by a zero out-degree.
    """
    repeated = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("mult")))
    return _votes(edges, ranks, salt_chunk).select("dst", "vote", repeated.alias("n")).drop("n")


def rank_step(edges: DataFrame, ranks: DataFrame, damping: float = DAMPING,
              base: float = BASE, salt_chunk: int = SALT_CHUNK) -> DataFrame:
    """(id, rank, prev): one update; every vertex of ``ranks`` keeps a row (R2)."""
    sums = _votes(edges, ranks, salt_chunk).groupBy(F.col("dst").alias("id")).agg(
        exact_sum(F.col("vote") * F.col("mult")).alias("s"))
    return ranks.join(sums, "id", "left").select(
        "id",
        (F.lit(base) + F.lit(damping) * F.coalesce("s", F.lit(0.0))).alias("rank"),
        F.col("rank").alias("prev"))


def l1_delta_col(new: str = "rank", old: str = "prev") -> Column:
    """sum |new - old| over all vertices, absolute, not divided by N (R3);
    the same for any order of the rows."""
    return F.coalesce(exact_sum(F.abs(F.col(new) - F.col(old))), F.lit(0.0))


def fixed_point_delta_col(new: str = "rank", old: str = "prev",
                          scale: int = FIXED_POINT_SCALE) -> Column:
    """sum of per-vertex truncated |new - old| * scale, divided by scale."""
    return F.coalesce(F.sum(fixed_point(F.col(new) - F.col(old), scale)),
                      F.lit(0)) / F.lit(float(scale))


def l1_delta(step: DataFrame) -> float:
    return float(step.agg(l1_delta_col().alias("d")).first()["d"])


def fixed_point_delta(step: DataFrame) -> float:
    return float(step.agg(fixed_point_delta_col().alias("d")).first()["d"])
