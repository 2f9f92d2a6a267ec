"""A training corpus in five stages, each of which works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns of `documents`; the last one adds how much
of each document the mix takes. `run` writes each stage as Parquet under spark.checkpoint.dir and reads it again, so a
lost executor costs tasks of one stage and no stage holds the plan of another.

NULL or letterless texts leave in the first stage. Tables may be empty, rows may be repeated, and further columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ebbtide.llm import bm25_index, dart_minhash, exact_blocks, language_tree, mixing
from ebbtide.llm.tables import table
from ebbtide.session import materialise


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, learned from the documents that are not held out; what it rejects goes."""
    return language_tree.keep_identified(docs, language_tree.learn(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of equal texts."""
    return exact_blocks.drop_exact(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the document with the smallest doc_id of each group of near duplicates."""
    return dart_minhash.drop_near(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a test item go."""
    return bm25_index.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the documents that the mix takes, with mix_size, mix_target and mix_taken."""
    return mixing.mix_documents(docs)


STAGES = [
    ("language", known_language),
    ("exact", without_copies),
    ("near", without_near_copies),
    ("benchmark", without_benchmark),
    ("mix", mixed_sources),
]

#: The first stage is a trained model, which SQL cannot express; tests hold `run` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
