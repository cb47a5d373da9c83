"""The corpus pipeline: ``documents`` through five stages, each written as
Parquet and read again as the next one's input.

1. quality: texts that the quality classifier rejects (score under 0.7) go;
2. near-duplicates: of every SimHash group the smallest doc_id stays;
3. decontamination: documents into which a benchmark item has leaked go;
4. secrets: what the secret scan holds to be a secret is redacted;
5. mix: every document as often as the mix of sources takes it, with the
   number of the copy.

All stages but the last return the columns of ``documents``.  Every model is
trained from the stage's own input and the tables in ``sf_dir``.  Nulls,
empty texts, repeated rows, empty tables and further columns are handled as
the operators' modules say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rankflow.llm import decontaminate, mixing, quality, secrets, simhash
from rankflow.llm.common import table
from rankflow.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, k=3, radius=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(secrets.labelled_findings(spark)))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mix", mixing_stage),
]

#: The classifier, the fingerprints and the forest are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what lies between them is in the
    shared folder of the session, so a lost executor costs no stage.  A
    stage's output goes when the next one's is stored; the last one stays, as
    the result reads it."""
    place = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
        if k:
            _remove(spark, f"{place}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
