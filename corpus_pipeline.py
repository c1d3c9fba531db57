"""Documents to token ids: language ID, exact and near dedup, mixing to target weights, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmark.llm import bagminhash, bpe, language, mixing, recipes
from leafmark.llm.common import stored, table
from leafmark.llm.queries import vocabulary_path


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told go."""
    return language.reject_undetermined(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents whose texts are equal up to white space stays."""
    return recipes.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return bagminhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to."""
    return bpe.encode(docs, vocabulary_path(), [c for c in docs.columns if c != "text"])


STAGES = [
    ("language ID", with_language),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]
#: SQL can express neither the signatures nor the merges; tests/llm compares every stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
