"""The corpus pipeline: documents in, packed training sequences out. Counts as part of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.exact_dedup import keep_distinct
from quireflow.llm.near_copies import keep_one_each
from quireflow.llm.packing import pack_documents
from quireflow.llm.quality import keep_good
from quireflow.llm.queries import BYTE_BPE
from quireflow.llm.secrets import redact
from quireflow.session import table
from quireflow.sources.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for junk or toxic go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return keep_distinct(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word Jaccard similarities of .8 or more, found by SimHash and MinHash, the one with the smallest doc_id stays."""
    return keep_one_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in its text is replaced by a mark, and n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    return pack_documents(docs, BYTE_BPE)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("near-dedup", near_copies),
    ("secret scans", secrets),
    ("packing", packing),
]

#: The stages score, fingerprint and tokenize; SQL doesn't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
