"""The next row of a group in a total order, safe for hot groups.

``lead(value) OVER (PARTITION BY group ORDER BY keys)`` puts every group
into one task; a group holding a third of all rows would make one task do a
third of the work.  Here the rows are range-partitioned on the full key
(group, keys...), so a hot group is split over as many slices as its share
of the sample says, and the slices are materialised once, reliably.  The
window runs inside a slice; the last row of a group in a slice takes the
group's first row in the next slice that has it.  There is one plan for all
sizes, and both steps read the same materialised slices.

That moves every row twice.  Where groups are mostly small (``count_first``)
they are counted before, and only those of more than ``HOT_ROWS`` rows are
sliced; the others move once, to the window that holds them whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


# Rows of a group above which it is cut into slices.
HOT_ROWS = 100_000


def next_in_group(df: DataFrame, group: str, keys: list[str], value: str,
                  out: str = "next_value", keep: list[str] | None = None,
                  num_partitions: int | None = None, count_first: bool = False,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, keep..., value, out): ``out`` is ``value`` of the next row of
    the same group in (keys...) order, null for the last row of a group.

    The keys must order the rows of a group totally (no ties), as with
    ``lead`` over a unique order.  Null is a group like any other.
    ``count_first`` counts the groups in a pass of its own and leaves those
    of at most ``hot_rows`` rows whole.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if count_first:
        wanted = list(dict.fromkeys([group, *(keep or []), value]))
        here = F.lead(value).over(Window.partitionBy(group).orderBy(*keys))
        hot = df.groupBy(F.col(group).alias("hot_group")).agg(F.count(F.lit(1)).alias("hot_n")).where(
            F.col("hot_n") > hot_rows).select("hot_group").checkpoint(eager=True)
        if hot.isEmpty():
            return df.select(*wanted, here.alias(out))
        # at most one row per hot_rows rows of the table
        is_hot = F.col(group).eqNullSafe(F.col("hot_group"))
        cold = df.join(F.broadcast(hot), is_hot, "left_anti").select(*wanted, here.alias(out))
        return cold.unionByName(next_in_group(df.join(F.broadcast(hot), is_hot, "left_semi"), group, keys, value,
                                              out, keep, num_partitions))
    order = [group, *keys]
    cols = list(dict.fromkeys([*order, value, *(keep or [])]))
    names = {c: f"c{i}" for i, c in enumerate(cols)}     # no clash with our own columns
    n = [num_partitions] if num_partitions else []
    slices = (df.select(*[F.col(c).alias(names[c]) for c in cols])
              .repartitionByRange(*n, *[names[c] for c in order])
              .withColumn("slice", F.spark_partition_id()).checkpoint(eager=True))
    g, k, v = names[group], [names[c] for c in keys], names[value]
    # a struct, so that a null value is not taken for a missing next row
    here = F.lead(F.struct(F.col(v).alias("v"))).over(Window.partitionBy("slice", g).orderBy(*k))
    heads = slices.groupBy("slice", g).agg(
        F.min(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(k)],
                       F.col(v).alias("v"))).alias("head"))
    # only groups that a slice boundary cuts: at most one per slice
    cut = heads.select("slice", F.col(g).alias("cut_group"), F.lead("head").over(
        Window.partitionBy(g).orderBy("slice")).alias("head")).where("head IS NOT NULL")
    rows = slices.withColumn("here", here).alias("r").join(
        F.broadcast(cut).alias("n"),
        (F.col("r.slice") == F.col("n.slice")) & F.col(f"r.{g}").eqNullSafe(F.col("cut_group")), "left")
    nxt = F.when(F.col("here").isNotNull(), F.col("here.v")).otherwise(F.col("head.v"))
    wanted = list(dict.fromkeys([group, *(keep or []), value]))
    return rows.select(*[F.col(f"r.{names[c]}").alias(c) for c in wanted], nxt.alias(out))
