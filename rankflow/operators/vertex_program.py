"""A general vertex program (BSP shape) written only with Column expressions.

Per superstep: every active vertex with out-edges sends one message of one
or more fields to all its out-edges, each edge may change it by its own
values, messages are combined per target by any aggregate expressions (a
partial + final aggregate, so a hot target is combined map-side; equal
messages can be counted first), each vertex that is active or received a
message applies ``update``, named aggregators are computed over the updated
vertices and are seen by the vertices of the next superstep, and the master
hook (driver side, scalars only) may halt before the next superstep.
Loop-invariant edges and the partitioned state come from
``plans.loop.prepare`` (co-partitioned join, hot sources salted).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact_sum
from ..plans.loop import MAX_ITERATIONS, LinkGraph, _LoopConf, deliver, prepare, sum_by_target

_COMBINERS = ("sum", "min", "max")


@dataclass
class VertexProgramResult:
    vertices: DataFrame              # id, <value columns>
    supersteps: int                  # last superstep that ran an update
    aggregates: list[dict]           # per superstep: {'superstep': s, name: value}
    halted_by: str                   # master | inactive | max_supersteps


def _combined(g: LinkGraph, joined: DataFrame, combine: str | dict[str, Column], fields: list[str],
              count_equal: bool) -> DataFrame:
    """(id, <combined columns>): one row per target of a message."""
    if isinstance(combine, str) and combine == "sum" and count_equal:
        joined, count_equal = joined.groupBy("dst", *fields).agg(F.sum("mult").alias("mult")), False
    if isinstance(combine, str):
        if fields != ["m"]:
            raise ValueError("a message of several fields needs its own aggregate expressions")
        if combine not in _COMBINERS:
            raise ValueError(f"combine must be one of {_COMBINERS} or aggregate expressions")
        val = F.col("m") * F.col("mult") if combine == "sum" else F.col("m")
        how = {"min": F.min, "max": F.max, "sum": F.sum}[combine]
        if combine == "sum" and isinstance(joined.schema["m"].dataType, (T.DoubleType, T.FloatType)):
            # the same for any order of the messages
            return sum_by_target(g, joined, val, F.lit(True).alias("__got")).withColumnRenamed("s", "msg")
        combine = {"msg": how(val)}
    if count_equal:
        joined = joined.groupBy("dst", *fields).agg(F.sum("mult").alias("mult"))
    return joined.groupBy(F.col("dst").alias("id")).agg(
        *[c.alias(k) for k, c in combine.items()], F.lit(True).alias("__got"))


def vertex_program(edges: DataFrame, init: dict[str, Column], send: Column | dict[str, Column],
                   update: dict[str, Column], combine: str | dict[str, Column] = "sum",
                   along: dict[str, Column] | None = None, count_equal: bool = False,
                   aggregators: dict[str, Column] | None = None,
                   halt: Callable[[int, dict], bool] | None = None,
                   vote_to_halt: Column | None = None,
                   max_supersteps: int = MAX_ITERATIONS,
                   checkpoint_every: int = 1, graph: LinkGraph | None = None,
                   vertices: DataFrame | None = None,
                   **prep_kw) -> VertexProgramResult:
    """Run a vertex program over the edge multiset ``edges`` (src, dst).

    ``send`` is a message of one field ``m``, or its fields by name.
    ``along`` gives fields anew on each edge, from the fields and the edge's
    ``values`` (columns of ``edges`` named by the option ``values``).

    ``combine``: 'sum', 'min' or 'max' of ``m``, seen as ``msg`` (null if no
    message arrived), or aggregate expressions by name over the message
    fields.  Parallel edges that carry the same message are one row with
    their number in ``mult``, so counting expressions must use it.  With
    ``count_equal`` equal messages of all sources are first counted the same
    way, split by target and message, so that expressions over many messages
    need little memory (the most frequent one: the largest ``mult``).

    Expressions may use ``outdeg``, the value columns, the combined columns,
    ``superstep`` and ``agg_<name>``, the aggregators of the superstep before
    (0.0 in the first).  ``vote_to_halt`` and the aggregators see the new
    values and the previous ones as ``old_<name>``.
    ``halt(s, aggregates_of_s_minus_1)`` is the master hook, called before
    superstep s >= 1.

    ``vertices`` (optional, one row per id): its columns are visible to the
    ``init`` expressions, and ids without any edge join the program with
    out-degree 0 (they only ever run in superstep 1).
    """
    own = graph is None
    g = graph or prepare(edges, **prep_kw)
    spark = g.vertices.sparkSession
    names = list(init)
    aggregators = aggregators or {}
    fields = dict(send) if isinstance(send, dict) else {"m": send}
    base_v = g.vertices.select("id", "outdeg", "nsalt")
    if vertices is not None:
        base_v = vertices.join(base_v, "id", "full").select(
            "*", F.coalesce("outdeg", F.lit(0)).alias("_od"),
            F.coalesce("nsalt", F.lit(1)).alias("_ns")).drop("outdeg", "nsalt") \
            .withColumnRenamed("_od", "outdeg").withColumnRenamed("_ns", "nsalt")
    state = base_v.select("id", "outdeg", "nsalt",
                          *[init[n].alias(n) for n in names],
                          F.lit(True).alias("active"))
    history: list[dict] = []
    prev_aggs: dict = dict.fromkeys(aggregators, 0.0)
    halted_by = "max_supersteps"
    last = 0
    cached = None
    with _LoopConf(spark, g.num_partitions, adaptive=False):
        for s in range(1, max_supersteps + 1):
            if halt is not None and halt(s, prev_aggs):
                halted_by = "master"
                break
            seen = {"superstep": F.lit(s), **{f"agg_{k}": F.lit(v) for k, v in prev_aggs.items()}}
            state = state.withColumns(seen)
            senders = state.where(F.col("active") & (F.col("outdeg") > 0)).select(
                "id", "nsalt", *[c.alias(k) for k, c in fields.items()])
            joined = deliver(g, senders, *fields)
            if along:
                joined = joined.select("dst", "mult", *[along.get(k, F.col(k)).alias(k) for k in fields])
            msgs = _combined(g, joined, combine, list(fields), count_equal)
            j = state.join(msgs.hint("shuffle_hash"), "id", "left")
            run_it = F.col("active") | F.col("__got").isNotNull()
            cols = [F.when(run_it, update[n]).otherwise(F.col(n)).alias(n) for n in names]
            olds = [F.col(n).alias(f"old_{n}") for n in names]
            stepped = j.select("id", "outdeg", "nsalt", *cols, *olds, run_it.alias("ran"), *seen)
            # vote to halt sees the new values and old_<name>; a vertex that did
            # not run stays halted until a message arrives; the vertex of
            # superstep == max_supersteps votes to halt (cap)
            halt_col = vote_to_halt if vote_to_halt is not None else F.lit(False)
            active = F.col("ran") & ~halt_col & F.lit(s < max_supersteps)
            new = stepped.select("id", "outdeg", "nsalt", *names, active.alias("active"),
                                 *[f"old_{n}" for n in names], "ran")
            agg_cols = [e.alias(k) for k, e in aggregators.items()]
            agg_cols.append(F.coalesce(F.max(F.col("active").cast("int")), F.lit(0))
                            .alias("__any"))
            keep = ["id", "outdeg", "nsalt", *names, "active"]
            if checkpoint_every and s % checkpoint_every == 0:
                # aggregators observed in the result stage of the checkpoint
                # job; only the state columns are written
                obs = Observation(f"rankflow_superstep_{s}")
                new = new.observe(obs, *agg_cols).select(*keep).checkpoint(eager=True)
                row = obs.get
            else:
                new = new.persist(StorageLevel.MEMORY_AND_DISK)
                row = new.agg(*agg_cols).first().asDict()
            prev_aggs = {k: 0.0 if row[k] is None else row[k] for k in aggregators}
            history.append({"superstep": s, **prev_aggs})
            if cached is not None:
                cached.unpersist()
            cached = new
            state = new.select("id", "outdeg", "nsalt", *names, "active")
            last = s
            if not row["__any"]:
                halted_by = "inactive" if s < max_supersteps else "max_supersteps"
                break
    if own and checkpoint_every == 1:
        g.release()        # the final state is read from its checkpoint
    return VertexProgramResult(state.select("id", *names), last, history, halted_by)


def link_rank_program(edges: DataFrame, tol: float = 1e-4, damping: float = 0.85,
                      base: float = 0.15, max_supersteps: int = MAX_ITERATIONS,
                      **kw) -> VertexProgramResult:
    """Link rank as one vertex program: equals ``rank_until(delta='l1', lag=0)``."""
    return vertex_program(
        edges,
        init={"rank": F.lit(1.0)},
        send=F.col("rank") / F.col("outdeg"),
        update={"rank": F.lit(base) + F.lit(damping) * F.coalesce("msg", F.lit(0.0))},
        combine="sum",
        aggregators={"sum_diff": exact_sum(F.abs(F.col("rank") - F.col("old_rank")))},
        halt=lambda s, agg: s > 1 and agg["sum_diff"] < tol,
        max_supersteps=max_supersteps, **kw)
