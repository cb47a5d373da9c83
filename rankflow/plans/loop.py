"""The iterative link-rank loop on Spark.

Plan per update (the only driver work is one scalar row per update):

* ``prepare`` runs once: collapse parallel edges into a multiplicity (the
  only pass over the input, cut by a reliable checkpoint), compute
  out-degrees and the vertex set from it, and lay out vertices by id and
  edges by src, persisted, with the same partition count.
* Ranks reach the edges by a **co-partitioned join**: the state is
  hash-partitioned by id and the edges of ordinary sources by src with the
  same partition count, so the vote join needs no exchange at all.
  Sources whose distinct fan-out exceeds ``salt_chunk`` (a "hot" source
  holding, say, a third of all edges) are **salted**: their edges are spread
  over ``nsalt = ceil(fanout / salt_chunk)`` buckets partitioned by
  (src, salt), the join that finds them is salted too, and only their vote rows are replicated ``nsalt`` times and
  shuffled (at most E / salt_chunk rows).  A **broadcast** of the votes is
  available as an option and is refused when the vertex count times a
  per-row size estimate exceeds the broadcast limit.
* Votes of a large graph move to their target as single numbers and are
  summed there: a partial sum is five numbers and has few votes to combine.
  In a small graph, or one with a hot target (more distinct in-edges than
  SALT_CHUNK), they are summed with a partial (map-side) + final aggregate, which absorbs a target
  that receives a third of all votes.  The sums are exact (``functions.exact_sum``), so ranks, deltas and the number of
  updates do not depend on the partitioning or on retried tasks.
* A large graph without hot sources and targets can go further (**packed**
  votes, an option): the edges keep a fixed order, so one array of votes per partition
  and part of the targets moves, without ids; the targets lie in the same
  order where the votes arrive and are never moved again.
* Vertices may also be given as a table, with start values of their own; it
  meets the ends of the edges in the one exchange that finds the vertices.
* The sums are left-joined to the state, which stays hash-partitioned by
  id from one update to the next, so the state side is never shuffled.
* Every update is written reliably (``checkpoint()`` into the session's
  ``spark.checkpoint.dir``, or a parquet snapshot ``iter=<k>``): lineage
  stays one update deep and a lost executor costs at most one update.  The
  deltas are observed in the same job (``observe``, result stage, so task
  retries do not count twice).  ``checkpoint_every > 1`` persists the
  updates in between instead; it is slower here, as the growing logical
  plan has to be re-planned each update.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact_sum
from ..operators.rank import (BASE, DAMPING, SALT_CHUNK, fixed_point_delta_col,
                              l1_delta_col, tag_salts)
from ..session import ensure_checkpoint_dir
from .tables import read_bucketed, write_bucketed

# The study's convergence threshold and update cap.
TOLERANCE = 1e-4
MAX_ITERATIONS = 500
# Edge rows per partition aimed at when the partition count is chosen (a
# partition then has at most twice as many vertices), and the fewest worth a
# task of their own.
EDGE_ROWS_PER_PARTITION = 1_000_000
MIN_EDGE_ROWS_PER_PARTITION = 10_000
# Distinct edges from which votes move as single numbers (a small graph has few
# partitions and combines well).
SINGLE_EDGE_ROWS = 1_000_000
# Distinct edges from which votes travel packed, and the parts that the
# targets of a partition are dealt into.
PACK_EDGE_ROWS = 2_000_000
PARTS_PER_PARTITION = 8

HISTORY_SCHEMA = T.StructType([
    T.StructField("iter", T.IntegerType(), False),
    T.StructField("delta", T.DoubleType(), False),
    T.StructField("delta_fixed", T.DoubleType(), False),
])
# a marker also tells into how many buckets its snapshot is laid out
MARKER_SCHEMA = T.StructType([*HISTORY_SCHEMA.fields, T.StructField("buckets", T.IntegerType())])
STATUS_SCHEMA = T.StructType([
    T.StructField("status", T.StringType(), False),
    T.StructField("iterations", T.IntegerType(), False),
    T.StructField("final_delta", T.DoubleType(), False),
])


GRAPH_SCHEMA = "num_vertices bigint, num_hot bigint, num_partitions int, hot boolean, values array<string>"


@dataclass
class LinkGraph:
    """A prepared graph: loop-invariant data, materialised once."""

    vertices: DataFrame          # id, outdeg, nsalt, start, hot_target; hash-partitioned by id
    edges: DataFrame             # src, dst, values, mult of non-hot sources; partitioned by src
    hot_edges: DataFrame | None  # src, salt, dst, values, mult of hot sources; by (src, salt)
    num_vertices: int
    num_hot: int
    num_partitions: int
    broadcast: bool
    values: tuple[str, ...] = ()  # edge values carried along
    single_votes: bool = False    # votes move uncombined: large, without a hot target
    slots: DataFrame | None = None  # part, run, dst array: targets of packed votes; partitioned by part

    def release(self) -> None:
        """Drop the persisted copies (results read from checkpoints stay valid)."""
        for df in (self.vertices, self.edges, self.hot_edges, self.slots):
            if df is not None:
                df.unpersist()


@dataclass
class RankResult:
    """Outcome of a loop.

    ``iterations`` counts the updates applied, including the extra one of
    ``lag=1``; ``final_delta`` is the last tested delta (with ``lag=1`` the
    one that met the tolerance); ``history`` has one row per update.
    """

    ranks: DataFrame             # id, rank
    history: DataFrame           # iter, delta, delta_fixed
    status: str                  # converged | max_iterations
    iterations: int              # updates applied
    final_delta: float           # the last tested delta
    state: DataFrame = field(repr=False, default=None)  # id, rank, prev, outdeg, nsalt

    def status_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.status, self.iterations, float(self.final_delta))], STATUS_SCHEMA)


def _bytes_conf(spark: SparkSession, key: str, default: int) -> int:
    raw = spark.conf.get(key, None)
    if raw is None:
        return default
    m = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)b?\s*", raw.lower())
    if not m:
        return default
    mult = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}[m.group(2)]
    return int(m.group(1)) * mult


def choose_partitions(spark: SparkSession, edge_rows: int) -> int:
    """Partitions for the loop: one per EDGE_ROWS_PER_PARTITION edges, so the
    hash join's build side stays small at any size; at least the session's
    parallelism or shuffle partitions, but not below
    MIN_EDGE_ROWS_PER_PARTITION edges each, so a small graph stays small."""
    floor = max(spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    want = -(-edge_rows // EDGE_ROWS_PER_PARTITION)
    return max(1, want, min(floor, -(-edge_rows // MIN_EDGE_ROWS_PER_PARTITION)))


def prepare(edges: DataFrame, num_partitions: int | None = None,
            broadcast: bool = False, broadcast_bytes: int | None = None,
            salt_chunk: int = SALT_CHUNK, vertices: DataFrame | None = None,
            start: float = 1.0, values: tuple[str, ...] = (), packed: bool | None = False) -> LinkGraph:
    """Materialise the loop-invariant part of the graph.

    ``vertices`` (id, rank) declares vertices, with or without edges, and
    their start values (of rows with the same id the largest value counts;
    rows without an id none).  A vertex that no row gives a value, because it
    is the end of an edge only or its rank is null, starts from ``start``.
    ``values`` are columns of ``edges`` that stay with them: parallel edges
    are counted together only where these are equal too.

    ``broadcast=True`` asks for a broadcast of the vote table; it is granted
    only if one row per vertex (16 bytes plus the id size) fits below
    ``broadcast_bytes`` (default: the session's
    ``spark.sql.autoBroadcastJoinThreshold``), else the co-partitioned join
    is used, which has no size limit and no exchange on either side.

    ``packed`` lays the graph out for packed votes (``step``), which move
    half the bytes and take more CPU time: for many updates of a large graph.
    None: from PACK_EDGE_ROWS distinct edges on.  Graphs with hot sources or targets,
    edge values or a broadcast never are.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    # Parallel edges collapse to a multiplicity (partial + final aggregate,
    # so a hot source or pair is combined map-side); this is the one job that
    # reads the input, and its reliable checkpoint cuts the lineage.  The
    # number of distinct edges is observed in the same job.
    obs = Observation("rankflow_edges")
    # edges with a null end name no vertex and are ignored
    edges = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    mult = (edges.groupBy("src", "dst", *values).agg(F.count(F.lit(1)).alias("mult"))
            .observe(obs, F.count(F.lit(1)).alias("e")).checkpoint(eager=True))
    rows = num_edges = int(obs.get["e"])
    declared = None
    if vertices is not None:
        # one row per declared vertex; counted, as a graph may have few edges
        seen = Observation("rankflow_vertices")
        kind = mult.schema["src"].dataType
        declared = (vertices.where(F.col("id").isNotNull())
                    .groupBy(F.col("id").cast(kind).alias("id")).agg(F.max("rank").cast("double").alias("start"))
                    .observe(seen, F.count(F.lit(1)).alias("v")).checkpoint(eager=True))
        rows = max(rows, int(seen.get["v"]))
    p = int(num_partitions or choose_partitions(spark, rows))
    with _LoopConf(spark, p, adaptive=False):
        # AQE off: the join output stays hash-partitioned by id with p
        # partitions, the layout the loop joins against; a lost block is
        # recomputed from the checkpoint, not from the input.
        # one pass and one exchange: both ends of an edge, counted by id
        ends = mult.select(F.explode(F.array(
            F.struct(F.col("src").alias("id"), F.col("mult").alias("out"), F.lit(1).alias("fan"),
                     F.lit(0).alias("fan_in")),
            F.struct(F.col("dst").alias("id"), F.lit(0).cast("bigint").alias("out"),
                     F.lit(0).alias("fan"), F.lit(1).alias("fan_in")))).alias("e")).select("e.*", F.lit(None).cast("double").alias("start"))
        if declared is not None:
            ends = ends.unionByName(declared.select("id", F.lit(0).cast("bigint").alias("out"),
                                                    F.lit(0).alias("fan"), F.lit(0).alias("fan_in"), "start"))
        verts = ends.groupBy("id").agg(F.sum("out").alias("outdeg"), F.sum("fan").alias("fanout"),
                                       F.sum("fan_in").alias("fanin"), F.max("start").alias("start")).select(
            "id", F.col("outdeg").cast("bigint").alias("outdeg"),
            F.greatest(F.lit(1), F.ceil(F.col("fanout") / F.lit(salt_chunk))).cast("int").alias("nsalt"),
            F.coalesce("start", F.lit(float(start))).alias("start"),
            (F.col("fanin") > SALT_CHUNK).alias("hot_target")
        ).persist(StorageLevel.MEMORY_AND_DISK)
        is_str = isinstance(verts.schema["id"].dataType, T.StringType)
        id_len = F.avg(F.length("id")) if is_str else F.lit(8.0)
        stats = verts.agg(F.count(F.lit(1)).alias("n"), id_len.alias("w"),
                          F.count_if(F.col("nsalt") > 1).alias("hot"),
                          F.count_if("hot_target").alias("hot_targets")).first()
    n = int(stats["n"])
    n_hot = int(stats["hot"])
    if broadcast:
        limit = broadcast_bytes if broadcast_bytes is not None else _bytes_conf(
            spark, "spark.sql.autoBroadcastJoinThreshold", 10 << 20)
        row_bytes = 16.0 + float(stats["w"] or 0.0)
        if limit <= 0 or n * row_bytes > limit:
            broadcast = False     # size check failed: use the partitioned join

    hot_edges = None
    if broadcast or n_hot == 0:
        emat = mult
    else:
        # the tagging join is salted itself; then the lineage is cut again
        hot = verts.where(F.col("nsalt") > 1).select(F.col("id").alias("src"), "nsalt")
        tagged = tag_salts(mult, hot, values, salt_chunk).withColumn("hot", F.col("nsalt") > 1).select(
            "src", "salt", "dst", *values, "mult", "hot").checkpoint(eager=True)
        emat = tagged.where(~F.col("hot")).select("src", "dst", *values, "mult")
        hot_edges = tagged.where(F.col("hot")).select("src", "salt", "dst", *values, "mult")
    if packed is None:
        packed = num_edges >= PACK_EDGE_ROWS
    packed = packed and not (broadcast or n_hot or int(stats["hot_targets"]) or values)
    slots = None
    if not broadcast:
        with _LoopConf(spark, p, adaptive=False):
            emat = emat.repartition(p, "src")
            if packed:
                # in an order that a recomputed partition has again
                emat = emat.withColumn("part", F.pmod(F.hash("dst"), F.lit(p * PARTS_PER_PARTITION))).sortWithinPartitions("part", "dst", "src")
            emat = emat.persist(StorageLevel.MEMORY_AND_DISK)
            emat.count()
            if packed:
                slots = pack(emat, "dst").repartition(p, "part").persist(StorageLevel.MEMORY_AND_DISK)
                slots.count()
            if hot_edges is not None:
                hot_edges = hot_edges.repartition(p, "src", "salt").persist(
                    StorageLevel.MEMORY_AND_DISK)
                hot_edges.count()
    return LinkGraph(verts, emat, hot_edges, n, n_hot, p, bool(broadcast), tuple(values),
                     num_edges >= SINGLE_EDGE_ROWS and not stats["hot_targets"], slots)


def save_graph(g: LinkGraph, base: str) -> None:
    """Write a prepared graph as folders bucketed by the loop's keys, for
    later runs and sessions (``load_graph``).  ``<base>/graph`` is written
    last, so a graph that was not written to its end is not loaded."""
    if g.broadcast:
        raise ValueError("a graph prepared for the broadcast join has no layout to keep")
    base, p, spark = base.rstrip("/"), g.num_partitions, g.vertices.sparkSession
    with _LoopConf(spark, p, adaptive=False):
        write_bucketed(g.vertices, f"{base}/vertices", p, "id")
        write_bucketed(g.edges.drop("part"), f"{base}/edges", p, "src")
        if g.hot_edges is not None:
            write_bucketed(g.hot_edges, f"{base}/hot_edges", p, "src", "salt")
    spark.createDataFrame([(g.num_vertices, g.num_hot, p, g.hot_edges is not None, list(g.values))], GRAPH_SCHEMA
                          ).coalesce(1).write.mode("overwrite").parquet(f"{base}/graph")


def load_graph(spark: SparkSession, base: str) -> LinkGraph:
    """A graph written by ``save_graph``.  It comes in the layout of the loop:
    nothing is counted, shuffled or tagged again."""
    ensure_checkpoint_dir(spark)
    base = base.rstrip("/")
    m = spark.read.parquet(f"{base}/graph").first()
    p = m["num_partitions"]

    def part(name, *keys):
        return read_bucketed(spark, f"{base}/{name}", p, *keys).persist(StorageLevel.MEMORY_AND_DISK)
    return LinkGraph(part("vertices", "id"), part("edges", "src"),
                     part("hot_edges", "src", "salt") if m["hot"] else None,
                     m["num_vertices"], m["num_hot"], p, False, tuple(m["values"]))


def initial_state(g: LinkGraph) -> DataFrame:
    return g.vertices.select("id", F.col("start").alias("rank"), F.col("start").alias("prev"),
                             "outdeg", "nsalt")


def deliver(g: LinkGraph, senders: DataFrame, *message: str) -> DataFrame:
    """(dst, <edge values>, mult, <message columns>): one row per distinct
    out-edge of every sender.

    ``senders`` has (id, nsalt, <message columns>) and keeps the state's
    partitioning by id; ordinary sources join their edges without an
    exchange, hot sources through their (src, salt) buckets.
    """
    out = ["dst", *g.values, "mult", *message]
    if g.broadcast:
        all_ = senders.select(F.col("id").alias("src"), *message)
        return g.edges.join(F.broadcast(all_), "src").select(*out)
    cold = senders.where(F.col("nsalt") == 1).select(F.col("id").alias("src"), *message)
    joined = g.edges.join(cold.hint("shuffle_hash"), "src").select(*out)
    if g.hot_edges is not None:
        hot = senders.where(F.col("nsalt") > 1).select(
            F.col("id").alias("src"), *message,
            F.explode(F.sequence(F.lit(0), F.col("nsalt") - 1)).alias("salt"))
        joined = joined.unionByName(
            g.hot_edges.join(hot.hint("shuffle_hash"), ["src", "salt"]).select(*out))
    return joined


def _runs(column: str) -> Callable:
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        part = rows.column("part").to_numpy()
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        run_ = np.full(len(first), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays(
            [pa.array(run_, pa.int32()), pa.array(part[first], pa.int32()), pa.ListArray.from_arrays(
                pa.array(np.r_[first, len(part)], pa.int32()), rows.column(column).combine_chunks())],
            ["run", "part", column])
    return run


def pack(rows: DataFrame, column: str) -> DataFrame:
    """(run, part, <column> array): the column's values of each part in each
    partition (run), where they lie next to each other, in their order.  A partition's values
    (of some EDGE_ROWS_PER_PARTITION edges) are in memory at once."""
    kind = rows.schema[column].dataType.simpleString()
    return rows.select("part", column).mapInArrow(_runs(column), f"run int, part int, {column} array<{kind}>")


def sum_by_target(g: LinkGraph, joined: DataFrame, number: Column, *more: Column) -> DataFrame:
    """(id, s, <more>): exact sum of ``number`` by target ``dst``.

    With ``single_votes`` every number moves as it is, in one exchange to the
    state's layout, and is summed there.
    """
    rows = joined.select(F.col("dst").alias("id"), number.alias("m"))
    if g.single_votes:
        rows = rows.repartition(g.num_partitions, "id")
    return rows.groupBy("id").agg(exact_sum("m").alias("s"), *more)


def step(g: LinkGraph, state: DataFrame, damping: float = DAMPING,
         base: float = BASE) -> DataFrame:
    """One update over the prepared graph: (id, rank, prev, outdeg, nsalt)."""
    vote = (F.col("rank") / F.col("outdeg")).alias("vote")
    if g.slots is not None:
        # the join streams the edges, so their order is that of the slots; all
        # votes of a target meet in one partition, and its sum moves once
        votes = state.where(F.col("outdeg") > 0).select(F.col("id").alias("src"), vote)
        sent = pack(g.edges.join(votes.hint("shuffle_hash"), "src").select(
            "part", (F.col("vote") * F.col("mult")).alias("m")), "m").repartition(g.num_partitions, "part")
        joined = g.slots.join(sent.hint("shuffle_hash"), ["part", "run"]).select(
            F.explode(F.arrays_zip("dst", "m")).alias("e")).select("e.dst", "e.m")
        sums = joined.groupBy(F.col("dst").alias("id")).agg(exact_sum("m").alias("s"))
        return _updated(state, sums, damping, base)
    if not g.broadcast and g.hot_edges is None:
        # every source is ordinary: the same join as ``deliver``, built with
        # fewer DataFrame calls (each one is analysed on the driver)
        votes = state.where(F.col("outdeg") > 0).select(F.col("id").alias("src"), vote)
        joined = g.edges.join(votes.hint("shuffle_hash"), "src")
    else:
        joined = deliver(g, state.where(F.col("outdeg") > 0).select("id", "nsalt", vote),
                         "vote")
    return _updated(state, sum_by_target(g, joined, F.col("vote") * F.col("mult")), damping, base)


def _updated(state: DataFrame, sums: DataFrame, damping: float, base: float) -> DataFrame:
    return state.join(sums.hint("shuffle_hash"), "id", "left").select(
        "id",
        (F.lit(base) + F.lit(damping) * F.coalesce("s", F.lit(0.0))).alias("rank"),
        F.col("rank").alias("prev"), "outdeg", "nsalt")


class _LoopConf:
    """Inside the loop: AQE off (stable co-partitioning), shuffle partitions = P;
    ``packed``: rows partitioned by part are so by (part, run)."""

    def __init__(self, spark: SparkSession, partitions: int, adaptive: bool, packed: bool = False):
        self.spark, self.p, self.adaptive, self.packed = spark, partitions, adaptive, packed

    def __enter__(self):
        self.saved = {k: self.spark.conf.get(k, None) for k in (
            "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions",
            "spark.sql.requireAllClusterKeysForCoPartition")}
        if self.packed:
            self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        if not self.adaptive:
            self.spark.conf.set("spark.sql.adaptive.enabled", "false")
        self.spark.conf.set("spark.sql.shuffle.partitions", str(self.p))
        return self

    def __exit__(self, *exc):
        for k, v in self.saved.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)


def _list_snapshots(spark: SparkSession, base: str) -> list[tuple[int, float, float, int | None]]:
    """(iter, delta, delta_fixed, buckets) of the complete snapshots, from the
    markers (one row per update, as the history has)."""
    try:
        m = spark.read.option("mergeSchema", True).parquet(f"{base.rstrip('/')}/manifest")
    except AnalysisException:           # no snapshot written yet
        return []
    buckets = F.max("buckets" if "buckets" in m.columns else F.lit(None).cast("int")).alias("buckets")
    rows = m.groupBy("iter", "delta", "delta_fixed").agg(buckets).collect()
    return sorted(((int(r["iter"]), r["delta"], r["delta_fixed"], r["buckets"]) for r in rows), key=lambda r: r[0])


def write_snapshot(state: DataFrame, base: str, i: int, deltas: list[tuple[int, float, float]],
                   complete: set[int] | None = None, buckets: int | None = None) -> None:
    """Write the state of update i to ``<base>/iter=<i>`` (K4), bucketed by id
    if ``buckets`` says into how many.

    The marker ``<base>/manifest/iter=<i>`` is written after the snapshot has
    committed and holds the deltas of the updates since the marker before, so
    a resume sees complete snapshots only and has the whole history.  A
    snapshot without a marker (a run that broke off) is written anew; one
    with a marker is an error.  ``complete``: the updates known to have one (read
    from the markers if not given).
    """
    base = base.rstrip("/")
    if complete is None:
        complete = {d[0] for d in _list_snapshots(state.sparkSession, base)}
    if i in complete:
        raise ValueError(f"snapshot {i} exists in {base}")
    if buckets:
        write_bucketed(state, f"{base}/iter={i}", buckets, "id")
    else:
        state.write.mode("overwrite").parquet(f"{base}/iter={i}")
    state.sparkSession.createDataFrame([(*d, buckets) for d in deltas], MARKER_SCHEMA).coalesce(1).write.mode(
        "overwrite").parquet(f"{base}/manifest/part={i}")


def read_snapshot(spark: SparkSession, base: str, i: int) -> DataFrame:
    """Read the state written by update i."""
    return spark.read.parquet(f"{base.rstrip('/')}/iter={i}")


def run(g: LinkGraph, *, max_iter: int = MAX_ITERATIONS, tol: float | None = TOLERANCE,
        delta: str = "l1", min_updates: int | None = None, lag: int = 0,
        damping: float = DAMPING, base: float = BASE, checkpoint_every: int = 1,
        snapshot_dir: str | None = None, resume: bool = False,
        adaptive: bool = False) -> RankResult:
    """Run updates until the tested delta is below ``tol`` or ``max_iter`` updates.

    ``delta``: 'l1' (sum of |new-old|, the BSP rule) or 'fixed_point'
    (per-vertex truncation to 1e-5, the batch rule).  ``min_updates``: first
    update whose delta is tested (1 for l1, 2 for fixed_point by default).
    ``lag=1``: apply one more update after the stop (the BSP engine sees the
    delta of update s only in superstep s+1).  ``tol=None``: fixed count.
    """
    if delta not in ("l1", "fixed_point"):
        raise ValueError("delta must be 'l1' or 'fixed_point'")
    if min_updates is None:
        min_updates = 1 if delta == "l1" else 2
    spark = g.vertices.sparkSession
    if adaptive:
        g = replace(g, slots=None)
    state = initial_state(g)
    k0 = 0
    history: list[tuple[int, float, float]] = []
    marked: list[tuple[int, float, float, int | None]] = []
    laid_out = False            # whether the resumed state has the layout of the loop
    if snapshot_dir:
        # the markers are read once; updates written from here on are added
        marked = _list_snapshots(spark, snapshot_dir)
    if marked and resume:
        history = [m[:3] for m in marked]
        k0, laid_out = marked[-1][0], marked[-1][3] == g.num_partitions
        state = (read_bucketed(spark, f"{snapshot_dir.rstrip('/')}/iter={k0}", g.num_partitions, "id")
                 if laid_out else read_snapshot(spark, snapshot_dir, k0))
    complete = {h[0] for h in marked}

    def measure(df: DataFrame) -> tuple[float, float]:
        r = df.agg(l1_delta_col().alias("d"), fixed_point_delta_col().alias("f")).first()
        return float(r["d"]), float(r["f"])

    def advance(df: DataFrame, k: int) -> tuple[DataFrame, float, float]:
        """Materialise update k and return it with its two deltas."""
        if checkpoint_every and k % checkpoint_every == 0:
            # the checkpoint keeps the layout by id that the next update joins
            # against; a snapshot is written from it
            obs = Observation(f"rankflow_delta_{k}")
            out = df.observe(obs, l1_delta_col().alias("d"),
                             fixed_point_delta_col().alias("f")).checkpoint(eager=True)
            m = obs.get
            d, f = float(m["d"]), float(m["f"])
            if snapshot_dir:
                since = [h for h in history if h[0] > max(complete, default=0)] + [(k, d, f)]
                write_snapshot(out, snapshot_dir, k, since, complete, g.num_partitions)
                complete.update(h[0] for h in since)
            return out, d, f
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
        return (out, *measure(out))

    status, last_tested = "max_iterations", 0.0
    k = k0
    cached: DataFrame | None = None
    with _LoopConf(spark, g.num_partitions, adaptive, g.slots is not None):
        if k0 > 0:
            if not laid_out:        # a snapshot of another layout: once into that of the loop
                state = state.repartition(g.num_partitions, "id").checkpoint(eager=True)
            _, d, f = history[-1]
            last_tested = d if delta == "l1" else f
            if tol is not None and k0 >= min_updates and last_tested < tol:
                status = "converged"
        while status != "converged" and k < max_iter:
            k += 1
            new, d, f = advance(step(g, state, damping, base), k)
            if cached is not None:
                cached.unpersist()
            cached = new if new.storageLevel.useMemory or new.storageLevel.useDisk else None
            state = new
            history.append((k, d, f))
            last_tested = d if delta == "l1" else f
            if tol is not None and k >= min_updates and last_tested < tol:
                status = "converged"
        if lag and status == "converged":
            for _ in range(lag):
                k += 1
                new, d, f = advance(step(g, state, damping, base), k)
                if cached is not None:
                    cached.unpersist()
                cached = new
                state = new
                history.append((k, d, f))
    if tol is None:
        status = "max_iterations"
    hist = spark.createDataFrame(history, HISTORY_SCHEMA)
    return RankResult(state.select("id", "rank"), hist, status, k, last_tested, state)


def _prepare_options(kw: dict) -> dict:
    """Takes the options of ``prepare`` out of ``kw``."""
    return {k: kw.pop(k) for k in ("num_partitions", "broadcast", "broadcast_bytes", "salt_chunk",
                                   "vertices", "start", "packed") if k in kw}


def rank_until(edges: DataFrame, tol: float = TOLERANCE, max_iter: int = MAX_ITERATIONS,
               delta: str = "l1", lag: int = 0, min_updates: int | None = None,
               **kw) -> RankResult:
    """Prepare and run to convergence (R6 with delta='l1', R7 with
    'fixed_point'); ``vertices`` and ``start`` as in ``prepare``."""
    prep_kw = _prepare_options(kw)
    g = prepare(edges, **prep_kw)
    try:
        return run(g, max_iter=max_iter, tol=tol, delta=delta, lag=lag,
                   min_updates=min_updates, **kw)
    finally:
        g.release()


def rank_fixed(edges: DataFrame, iterations: int, **kw) -> RankResult:
    """Exactly ``iterations`` updates, no convergence test."""
    prep_kw = _prepare_options(kw)
    g = prepare(edges, **prep_kw)
    try:
        return run(g, max_iter=iterations, tol=None, **kw)
    finally:
        g.release()


def rank_tagged_fixed(edges: DataFrame, iterations: int, damping: float = DAMPING,
                      base: float = BASE, **kw) -> DataFrame:
    """``iterations`` updates where votes and old values meet in one
    aggregation by id instead of a join (R8): typed rows (value or old) are
    unioned and reduced.  Only numbers move; the edges stay where they are."""
    g = prepare(edges, **kw)
    state = initial_state(g)
    with _LoopConf(edges.sparkSession, g.num_partitions, False):
        for _ in range(iterations):
            votes = deliver(g, state.where(F.col("outdeg") > 0).select(
                "id", "nsalt", (F.col("rank") / F.col("outdeg")).alias("vote")), "vote")
            rows = votes.select(F.col("dst").alias("id"), (F.col("vote") * F.col("mult")).alias("val"),
                                F.lit(None).cast("double").alias("old"), F.lit(None).cast("bigint").alias("outdeg"),
                                F.lit(None).cast("int").alias("nsalt")).unionByName(
                state.select("id", F.lit(None).cast("double").alias("val"), F.col("rank").alias("old"),
                             "outdeg", "nsalt"))
            state = rows.groupBy("id").agg(
                (F.lit(base) + F.lit(damping) * F.coalesce(exact_sum("val"), F.lit(0.0))).alias("rank"),
                F.coalesce(F.max("old"), F.lit(0.0)).alias("prev"), F.max("outdeg").alias("outdeg"),
                F.max("nsalt").alias("nsalt")).checkpoint(eager=True)
    g.release()
    return state.select("id", "rank")
