"""Text sources: edge lists, adjacency TSV, vertex JSON (log folders: ``sources.logs``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import split_drop_trailing, split_ws, try_double


def read_lines(spark: SparkSession, path: str, order: bool = False) -> DataFrame:
    """(value string): one row per text line (S1 input); with ``order`` also
    ``pos``, the line's place in the input."""
    lines = spark.read.text(path)
    if not order:
        return lines
    return lines.select("value", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")).alias("pos"))


def parse_edges(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(src string, dst string) from raw edge-list lines.

    Lines that start with '#' (tested before trimming) are comments; the
    rest is trimmed (all chars <= U+0020) and split on whitespace runs; lines
    with fewer than two tokens are dropped; tokens after the second are
    ignored.  A line ' # a b' (leading blank) is the edge ('#', 'a').  The
    columns ``keep`` stay.
    """
    toks = lines.where(~F.col(value).startswith("#")).select(split_ws(value).alias("t"), *keep)
    return toks.where(F.size("t") >= 2).select(
        F.col("t")[0].alias("src"), F.col("t")[1].alias("dst"), *keep)


def parse_adjacency_tsv(lines: DataFrame, value: str = "value") -> DataFrame:
    """(id string, rank double, nbrs array<string>) from ``id\\trank\\tn1,n2``.

    Rows with fewer than two fields are dropped; a missing or empty third
    field means no neighbours; a rank that is not a number becomes null.
    """
    parts = lines.select(split_drop_trailing(value, "\t").alias("p"))
    parts = parts.where(F.size("p") >= 2)
    links = F.coalesce(F.try_element_at("p", F.lit(3)), F.lit(""))
    return parts.select(
        F.col("p")[0].alias("id"),
        try_double(F.col("p")[1]).alias("rank"),
        # commas alone name no neighbour
        F.when(F.replace(links, F.lit(",")) == "", F.array().cast("array<string>"))
        .otherwise(split_drop_trailing(links, ",")).alias("nbrs"))


def adjacency_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) and declared vertices (id, rank) of parsed adjacency
    rows (S2), the two inputs of ``plans.loop.prepare``."""
    edges = parsed.select(F.col("id").alias("src"), F.explode("nbrs").alias("dst"))
    return edges, parsed.select("id", "rank")


def vertex_json_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, weight) and vertices (id, value) of parsed vertex
    JSON rows (S3)."""
    edges = parsed.select(F.col("id").alias("src"), F.explode("edges").alias("e")).select(
        "src", F.col("e.dst").alias("dst"), F.col("e.weight").alias("weight"))
    return edges, parsed.select("id", "value")


VERTEX_JSON_EDGE = "struct<dst:bigint,weight:float>"


def parse_vertex_json(lines: DataFrame, value: str = "value") -> DataFrame:
    """(id bigint, value double, edges array<struct<dst,weight>>) from
    ``[id,value,[[dst,weight],...]]`` lines (S3)."""
    el = F.from_json(F.col(value), "array<string>")
    pairs = F.from_json(el[2], "array<array<string>>")      # ids stay exact above 2^53
    return lines.select(
        el[0].try_cast("bigint").alias("id"),
        el[1].try_cast("double").alias("value"),
        F.transform(F.coalesce(pairs, F.array().cast("array<array<string>>")),
                    lambda x: F.struct(F.coalesce(x[0].try_cast("bigint"),
                                                  x[0].try_cast("double").try_cast("bigint")).alias("dst"),
                                       x[1].try_cast("float").alias("weight")))
        .cast(f"array<{VERTEX_JSON_EDGE}>").alias("edges"))


# ---------------------------------------------------------- rejected lines

# What is wrong with a line that a parser drops or reads as null.
TOO_FEW = "too few fields"
BAD_RANK = "rank is not a number"
BAD_ID = "vertex id is not a number"
BAD_VALUE = "vertex value is not a number"
BAD_EDGE = "edge is not a pair of numbers"


def reject_reason(fmt: str, value: str = "value") -> Column:
    """Why a line of the format ('edges', 'tsv' or 'json') is no row, or not
    a whole one; null for good lines and for comments."""
    v = F.col(value)
    if fmt == "edges":
        return F.when(~v.startswith("#") & (F.size(split_ws(value)) < 2), TOO_FEW)
    if fmt == "tsv":
        p = split_drop_trailing(value, "\t")
        return F.when(F.size(p) < 2, TOO_FEW).when(try_double(F.try_element_at(p, F.lit(2))).isNull(), BAD_RANK)
    el = F.from_json(v, "array<string>")
    pairs = F.from_json(F.try_element_at(el, F.lit(3)), "array<array<string>>")

    def bad(x):
        return ((F.size(x) != 2) | F.try_element_at(x, F.lit(1)).try_cast("double").try_cast("bigint").isNull()
                | F.try_element_at(x, F.lit(2)).try_cast("float").isNull())
    return (F.when(F.coalesce(F.size(el), F.lit(0)) < 3, TOO_FEW)
            .when(el[0].try_cast("bigint").isNull(), BAD_ID)
            .when(el[1].try_cast("double").isNull(), BAD_VALUE)
            .when(pairs.isNull() | F.exists(pairs, lambda x: x.isNull() | bad(x)), BAD_EDGE))


def rejects(lines: DataFrame, fmt: str, value: str = "value") -> DataFrame:
    """(value, reason): the lines that ``reject_reason`` names, beside the
    parsed rows."""
    return lines.select(value, reject_reason(fmt, value).alias("reason")).where("reason IS NOT NULL")


def count_rejects(lines: DataFrame, fmt: str, seen: Observation) -> DataFrame:
    """The same lines; the job that reads them also counts ``lines`` and, by
    reason, the rejected ones into ``seen`` (no pass of its own)."""
    reason = reject_reason(fmt)
    reasons = {"edges": [TOO_FEW], "tsv": [TOO_FEW, BAD_RANK], "json": [TOO_FEW, BAD_ID, BAD_VALUE, BAD_EDGE]}[fmt]
    return lines.observe(seen, F.count(F.lit(1)).alias("lines"),
                         *[F.count_if(reason == r).alias(r) for r in reasons])
