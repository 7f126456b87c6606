"""Five stages from raw documents to packed sequences; each works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackgrove.llm import packing, quality, secrets, simhash, substring
from stackgrove.llm.common import Scratch, read_table


def _with_size(docs: DataFrame) -> DataFrame:
    """n_chars made anew for a changed text, where the column is there."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; those it rejects go. A null text is judged as an empty one."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"), spark)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (see simhash.one_of_each), whether or not ids are null or repeated."""
    return simhash.one_of_each(docs, spark)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated word windows go out of the texts; every document stays, though its text may be empty. Null texts stay null."""
    return _with_size(substring.without_repeats(docs, spark))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays. Null texts stay null."""
    return _with_size(secrets.without_secrets(docs, spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences. A null text is an empty one, its end id alone."""
    return packing.packed_documents(docs, spark)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicates_stage),
    ("substring dedup", substring_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]
#: Learned scores, suffix trees and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again.

    Documents with null, empty or very long texts, null or repeated ids go through like any other, and extra
    columns pass all stages but the last. No documents: no rows.
    """
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
