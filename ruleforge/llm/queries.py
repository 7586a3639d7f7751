"""The queries opN_<name>, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact, lm, media, mixing, packing, passages, simhash, subword, wrapper
from .common import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents as stored media, read back."""
    return media.store_media(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its quality score."""
    return subword.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", 0.3)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every row of documents with its bin."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of documents that repeat in other documents."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of pages."""
    return wrapper.extract_pages(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the row of its text that stays."""
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its masked pseudo-likelihood."""
    return lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the words that the mix takes of it."""
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its fingerprint and its group of near-duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its toxicity score."""
    return subword.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", 0.5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_passages": op4_passages,
    "op5_main_text": op5_main_text,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pseudo_likelihood": op7_pseudo_likelihood,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op6_exact_dedup": exact.ORACLE,
    "op8_mixing": mixing.ORACLE,
}
