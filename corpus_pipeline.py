"""A training corpus from documents: quality rules, toxicity, near-duplicates, secrets, packing.

Every stage works on all rows that its predecessor kept, is written as Parquet and read back as the next one's
input. All but the last keep the columns of documents. Null and empty texts, repeated rows and empty tables: as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm.common import stored, table
from ledgerlake.llm.packing import op10_packing
from ledgerlake.llm.quality import kept_documents
from ledgerlake.llm.secrets import redacted
from ledgerlake.llm.simhash import one_of_each
from ledgerlake.llm.toxicity import not_toxic
from ledgerlake.plans.ship import ship_code


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed votes of the quality rules keep.

    Null and empty texts go (no word); copies are judged alike; very long texts are read whole; no rows give no rows.
    Column names and types do not matter, here and in the stages below.
    """
    ship_code(spark)
    return kept_documents(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the models learn from those labelled rows that are among docs.

    Null and empty texts have no evidence and stay unless the curve says otherwise there; copies stay or go together;
    with fewer than two labelled rows of a class all stay; no rows give no rows.
    """
    ship_code(spark)
    return not_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link: three-word shingles, three bits at most.

    The least id stays, of rows that repeat it the least text. Null and empty texts are one group; no rows give no rows.
    """
    ship_code(spark)
    return one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind and n_chars counted again.

    Null texts stay null; copies are scanned once and masked alike; a text without a find is as it was.
    """
    ship_code(spark)
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their places in packed sequences; null and empty texts are one end each."""
    ship_code(spark)
    return op10_packing(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: Models and hashes are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage left is removed once the next one has written its own."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", instead_of=before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
