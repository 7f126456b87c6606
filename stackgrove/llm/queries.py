"""Queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, media, neighbours, packing, quality, secrets, simhash, sql, substring, token_files, toxicity
from .common import read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents: fingerprints within two bits are linked."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), spark)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens."""
    return packing.packed_documents(read_table(spark, sf_dir, "documents"), spark)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the windows of 35 words that occur again."""
    return substring.digests(read_table(spark, sf_dir, "documents"), spark)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each secret of each document, by place and digest."""
    return secrets.secret_findings(read_table(spark, sf_dir, "documents"), spark)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document stored as an image, read back and described."""
    return media.text_media(read_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as read back from files of packed token ids."""
    return token_files.token_files(read_table(spark, sf_dir, "documents"), spark)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the text they decode to."""
    return bpe.encoded_digests(read_table(spark, sf_dir, "documents"), spark)


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth id."""
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), spark)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of each document."""
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), spark)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of each document, and the examples that gave it."""
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), spark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_best_fit_packing, op3_substring_dedup, op4_secrets, op5_media_columns, op6_token_files, op7_bpe, op8_neighbours, op9_quality, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
