"""Graph construction from an edge multiset (src, dst).

Edges are a multiset: parallel edges and self loops are kept everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Neighbours aimed at in one row of ``adjacency_parts``.
PART_EDGES = 1_000_000


def vertices(edges: DataFrame) -> DataFrame:
    """(id): every id seen as src or dst (G1)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def vertex_count(edges: DataFrame) -> int:
    """Number of distinct ids."""
    return vertices(edges).count()


def out_degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree): out-edges counted with parallels and loops; 0 for sinks.

    The count is a partial + final hash aggregate, so a source holding a
    large share of all edges is combined map-side before the shuffle.
    """
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("out")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("out").cast("bigint").alias("out_degree"))


def adjacency(edges: DataFrame, order_col: str | None = None) -> DataFrame:
    """(id, nbrs array): neighbours with duplicates, empty array for sinks.

    ``order_col`` (e.g. the input line position) fixes the neighbour order;
    without it the neighbours are sorted by value, which makes the result
    deterministic.  This is a format converter: a vertex's neighbours form one
    row by definition of the adjacency formats, so the ranking loop never uses
    it and works on edge rows instead.
    """
    if order_col is None:
        lists = edges.groupBy(F.col("src").alias("id")).agg(
            F.array_sort(F.collect_list("dst")).alias("nbrs"))
    else:
        lists = edges.groupBy(F.col("src").alias("id")).agg(
            F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                 F.col("dst").alias("d")))).alias("p"))
        lists = lists.select("id", F.transform("p", lambda x: x["d"]).alias("nbrs"))
    elem = edges.schema["dst"].dataType.simpleString()
    return vertices(edges).join(lists, "id", "left").select(
        "id", F.coalesce("nbrs", F.array().cast(f"array<{elem}>")).alias("nbrs"))


def adjacency_parts(edges: DataFrame, order_col: str | None = None,
                    part_edges: int = PART_EDGES) -> DataFrame:
    """(id, part, nbrs): ``adjacency`` with a vertex's neighbours in parts.

    A part holds fewer than twice ``part_edges`` neighbours, whatever a vertex
    has.  The parts of a vertex follow each other in ``part`` (its numbers may
    have gaps); joined in that order they are the list that ``adjacency``
    gives.  A sink has one empty part.  Edges with a null end name no vertex
    and are ignored.

    The edges are range-partitioned by vertex and order and stored once, so a
    hot vertex is spread over slices; rows are counted inside a vertex's slice
    only.  Without ``order_col`` parallel edges travel as one row and a count.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    if order_col is None:
        order = ["nbr", "o"]
        many = edges.groupBy(F.col("src").alias("id"), F.col("dst").alias("nbr")).agg(
            F.count(F.lit(1)).alias("n"))
        # more copies of an edge than a part holds are rows of their own
        rows = many.select("id", "nbr", "n", F.explode(
            F.sequence(F.lit(0), F.floor((F.col("n") - 1) / part_edges))).alias("o")).select(
            "id", "nbr", "o", F.least(F.lit(part_edges), F.col("n") - F.col("o") * part_edges).cast("int").alias("m"))
    else:
        order = ["o", "nbr"]
        rows = edges.select(F.col("src").alias("id"), F.col(order_col).alias("o"), F.col("dst").alias("nbr"),
                            F.lit(1).alias("m"))
    slices = rows.repartitionByRange("id", *order).withColumn("slice", F.spark_partition_id()).checkpoint(eager=True)
    inside = Window.partitionBy("slice", "id").orderBy(*order)
    placed = slices.withColumn("chunk", F.floor((F.sum("m").over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")) / part_edges))
    lists = placed.groupBy("slice", "id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct(*order, "m"))).alias("l"))
    parts = lists.select("id", (F.shiftleft(F.col("slice").cast("bigint"), 32) + F.col("chunk")).alias("part"),
                         F.flatten(F.transform("l", lambda x: F.array_repeat(x["nbr"], x["m"]))).alias("nbrs"))
    elem = edges.schema["dst"].dataType.simpleString()
    sinks = slices.select(F.col("nbr").alias("id")).distinct().join(slices.select("id").distinct(), "id", "left_anti")
    return parts.unionByName(sinks.select("id", F.lit(0).cast("bigint").alias("part"),
                                          F.array().cast(f"array<{elem}>").alias("nbrs")))


def explode_adjacency(adj: DataFrame, nbrs: str = "nbrs") -> DataFrame:
    """(src, dst): inverse of ``adjacency`` (G5); sinks yield no rows."""
    return adj.select(F.col("id").alias("src"), F.explode(nbrs).alias("dst"))


def init_ranks(verts: DataFrame, value: float = 1.0) -> DataFrame:
    """(id, rank): constant start value, 1.0 by default, not 1/N."""
    return verts.select("id", F.lit(float(value)).alias("rank"))
