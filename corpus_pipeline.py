"""From raw documents to packed training windows, in stages.

Each stage reads what the one before it wrote, with whatever columns documents
has; all but the last return them as they are.

Defined results. A null doc_id stays through all stages (it has no label and no
near duplicate) and comes first in its queue. Null and empty texts are judged by
their shape alone, are duplicates of nothing, leak nothing, hold no secret and
fill no window. Rows equal in doc_id and text become one; of near copies the
least doc_id stays. Equal scores and equal counts are decided alike. Very long
texts are read whole. An empty table of documents gives no windows; without any
labels all documents are kept by the first stage, and without a benchmark by the
third. Columns of other names, such as score, keep, group_id or window_id, are
passed on and clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirelake.llm import decontamination, neardup, packing, quality, secrets
from quirelake.plans import durable


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, one document stays."""
    return neardup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all documents stay."""
    return secrets.redacted(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Segments of documents by training window."""
    return packing.packed(docs)


STAGES = [
    ("quality-classifier", good_quality),
    ("minhash-near-dedup", one_of_each),
    ("benchmark-decontamination", decontaminated),
    ("secret-scans", without_secrets),
    ("packing", windows),
]

#: Learning and approximate search aren't SQL; the rows are held against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each reads what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable.written(stage(spark, docs, sf_dir), name)
    return docs
