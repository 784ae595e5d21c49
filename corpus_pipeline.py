"""Five stages from raw documents to packed training sequences.

Quality classifier and language identification drop what they reject, MinHash
keeps one document of each group, sources are mixed to target weights and the
mix is packed.  Every stage works on what its predecessor has kept: each
classifier is fitted on documents that are still there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpair.llm import language_id, minhash, mixing, packing, quality
from textpair.llm.common import read_table, small_batches, stored

# Language identification rejects texts it is less sure of than this, and those in none of the learned languages.
LEAST_LANGUAGE_SCORE = 0.5
# Near duplicates share at least this percentage of their word shingles; op9_minhash has its own.
NEAR_DUPLICATE_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.accepted(docs, quality.learn(docs, labels))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = language_id.learn(docs)
    return language_id.accepted(docs, model, LEAST_LANGUAGE_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash.deduplicated(docs, NEAR_DUPLICATE_PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, special_tokens=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs


# SQL cannot express hashing, learning and tokenising as the stages do them.
ORACLE_SQL: str | None = None

PIPELINE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
PIPELINE_ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
