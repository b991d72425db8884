"""The corpus pipeline: STAGES over documents, each over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it again. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import shared_dir, table
from quillon.llm.exact_dedup import drop_exact_copies
from quillon.llm.minhash import drop_near_copies
from quillon.llm.mixing import mixed_documents
from quillon.llm.packing import packed
from quillon.llm.quality import fit_quality, keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labels, rejects go."""
    net = fit_quality(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return keep_good(docs, net)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix to target weights takes them, repeats included."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids."""
    return packed(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("source mixing", mixing), ("packing", packing)]

#: SQL can't express the learned, sketching and retrieval stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs, own = table(spark, sf_dir, "documents"), uuid.uuid4().hex
    for n, (_, stage) in enumerate(STAGES):
        at = f"{shared_dir(spark)}/pipeline-{own}-{n}"
        stage(spark, docs, sf_dir).write.parquet(at)
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        docs = spark.read.parquet(at)
    return docs
