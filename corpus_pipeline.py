"""Corpus pipeline over the documents: quality, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
``docs``; all but the last return the columns of documents.  Nulls, empty texts, repeated rows and empty tables are
handled as the operators' modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glosspan.llm import decontaminate, neardup, packing, pii, quality
from glosspan.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts; it learns from the labels of the rows outside the held-out fold."""
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, net)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.keep_representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data masked."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", neardup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: A trained network, a fingerprint search and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{k}")
    return docs
