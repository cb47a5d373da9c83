"""Bucketed Parquet folders: a layout by key that outlives the session.

A folder is written through the session's catalog as an external table
bucketed by its keys, and the table is dropped again: what stays are plain
Parquet files whose names carry the bucket.  A reader that knows the keys and
the number of buckets declares them the same way and gets rows that are
hash-partitioned by the keys, so a join or a sum by them needs no exchange.
The table's name is new each time and exists only while a folder is written
or a plan is made of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _name() -> str:
    return f"rankflow_{uuid.uuid4().hex}"


def write_bucketed(df: DataFrame, path: str, buckets: int, *keys: str) -> None:
    """Writes (or overwrites) the folder.  Rows that are hash-partitioned by
    the keys into as many partitions give one file a bucket."""
    name = _name()
    try:
        (df.write.format("parquet").bucketBy(buckets, *keys).option("path", path)
         .mode("overwrite").saveAsTable(name))
    finally:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")   # external: the files stay


def read_bucketed(spark: SparkSession, path: str, buckets: int, *keys: str) -> DataFrame:
    """The folder's rows, hash-partitioned by the keys."""
    name = _name()
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS "
              f"LOCATION '{place}'")
    try:
        df = spark.table(name)
        # columns without the table's name, which a checkpoint of them would lose
        return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    finally:
        spark.sql(f"DROP TABLE {name}")
