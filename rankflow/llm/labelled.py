"""Bounded labelled training samples for the text classifiers."""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, saved


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int,
           per_class: int, max_bytes: int) -> DataFrame:
    """(t, y): texts and 0/1 labels of at most ``per_class`` ids of each class.

    Rows of the held-out fold (crc32 of the id modulo ``folds`` equal to
    ``held``) and texts above ``max_bytes`` are never among them; an id with
    several texts has the one of the smallest hash.  The ids are drawn from
    those with a text, in hash order, so reruns agree.  Ids with differing
    labels and null ids or labels are left out.
    """
    known = (labels.select("doc_id", F.col(label).cast("int").alias("y"))
             .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
             .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2"))
             .filter((F.col("y") == F.col("y2")) & (fold(F.col("doc_id"), folds) != held))
             .withColumn("h", F.xxhash64("doc_id")).select("doc_id", "y", "h"))
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("t"))
    text = text.filter(F.col("doc_id").isNotNull() & (F.octet_length("t") <= max_bytes)).withColumn("th", F.xxhash64("t"))
    # one row per id, of numbers only
    known = saved(text.groupBy("doc_id").agg(F.min("th").alias("th")).join(known, "doc_id"))
    ids = None
    for y in (0, 1):
        one = known.filter(F.col("y") == y).orderBy("h", "doc_id").limit(per_class)
        ids = one if ids is None else ids.unionByName(one)
    # at most 2 * per_class ids are broadcast; copies of a row have one text
    rows = text.join(F.broadcast(ids), ["doc_id", "th"]).groupBy("h", "doc_id", "y").agg(F.any_value("t").alias("t"))
    return rows.orderBy("h", "doc_id").limit(2 * per_class).select("t", "y")


def fit_in_task(rows: DataFrame, fit: Callable):
    """``fit(texts, labels)`` of a bounded sample, run in one task; only the
    model comes to the driver."""
    def run(batches):
        tables = list(batches)
        labels = [y for b in tables for y in b.column(1).to_pylist()]
        model = fit((t.as_py() for b in tables for t in b.column(0)), labels)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
    got = rows.coalesce(1).mapInArrow(run, "model binary").first()
    model = pickle.loads(got[0]) if got else fit(iter(()), [])
    if not model.fitted:
        warnings.warn("no model: the labelled rows within the limits are not of two classes; every score is 0.5",
                      RuntimeWarning, stacklevel=3)
    return model
