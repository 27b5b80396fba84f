"""From raw documents to packed token ids, in stages that each call one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.llm import decontam, mixing, near_dups, packing, quality
from hostloom.llm.common import settle, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-aware quality classifier rejects go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8 or more) stays."""
    return near_dups.deduplicated(docs).select(*docs.columns)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: the largest is used once, small ones up to twice, none is cut."""
    return mixing.repeated(docs, mixing.Mix(repeats=2.0))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of packed token ids."""
    return packing.packed(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("decontamination", no_leaks),
    ("mixing", mixed),
    ("token_ids", token_ids),
]

# fitted and randomised stages have no SQL; tests hold each against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
