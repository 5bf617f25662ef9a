"""A corpus pipeline: quality rules, line dedup, near-duplicates, personal data, packing.

Each stage works on what the one before it kept and wrote; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import materialize
from tidewatch.llm.jaccard import keep_one_similar
from tidewatch.llm.lines import dedup_lines
from tidewatch.llm.packing import pack_documents
from tidewatch.llm.pii import redact
from tidewatch.llm.quality import keep_good
from tidewatch.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule or their host's verdict rejects go."""
    ship(spark)
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages are cut out of the texts; every document stays."""
    ship(spark)
    return dedup_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that similarities of 0.8 or more between sets of five-word shingles connect."""
    ship(spark)
    return keep_one_similar(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    ship(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, the ids themselves, with their sequences and offsets."""
    ship(spark)
    return pack_documents(docs, with_ids=True)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("PII", personal_data), ("packing", packing)]

#: SQL cannot express the fingerprints, the span classifier and the packing; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
