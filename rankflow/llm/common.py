"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: White space of the word classes ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def saved(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: computed once, lineage cut,
    readable after any executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (a null id: fold of the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Smallest node reachable from every node: (node, component).

    ``nodes`` has one column ``node``, ``links`` has ``a`` and ``b`` (either
    direction, repeats and loops allowed); both nodes of a link must be in
    ``nodes``.  Alternates a step to the smallest neighbour label with
    pointer jumping, so chains shorten to half per round; every state is
    checkpointed.  Only a count of changed rows reaches the driver.  Hubs
    meet a partial minimum before the shuffle.
    """
    links = links.select("a", "b").filter("a <> b").distinct()
    links = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    # nodes without links need no rounds
    state = saved(links.select(F.col("a").alias("node")).distinct().withColumn("c", F.col("node")))
    for _ in range(max_rounds):
        near = (links.join(state.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("c").alias("m")))
        hop = (state.join(near, "node", "left")
               .select("node", F.col("c").alias("old"), F.least("c", "m").alias("t")))
        up = state.select(F.col("node").alias("t"), F.col("c").alias("tc"))
        nxt = saved(hop.join(up, "t", "left")
                    .select("node", "old", F.least("t", "tc").alias("c")))
        changed = nxt.filter("c <> old").limit(1).count()
        state = nxt.select("node", "c")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return (nodes.select("node").join(state, "node", "left")
            .select("node", F.coalesce("c", "node").alias("component")))
