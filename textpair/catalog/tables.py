"""Text-to-query tables derived from the shared test tables.

Every derivation is a narrow projection of a whole table; only ``dialog`` and
``vec_pairs`` need a shuffle, for the window and the join that define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpair.functions.rouge import with_rouge_scores
from textpair.functions.text import (
    SPACE, WORD, joined_for_evaluation, sentence_newlines, strip_text, word_slice, words,
)
from textpair.sources.metric_logs import EVAL_KEYS, FINAL_KEYS, TRAIN_KEYS

MODELS = ["lead", "mid", "tail"]
TEXT_COLS = ["title", "description"]
TITLE = f"^(?:{SPACE}*{WORD}){{0,8}}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product per document: the head is the title, all the rest the description."""
    docs = read_table(spark, sf_dir, "documents")
    head = F.regexp_extract("text", TITLE, 0)
    titled = docs.select(
        F.col("doc_id").alias("product_id"),
        word_slice(head, 1, 8).alias("title"),
        F.nullif(strip_text(F.regexp_replace("text", TITLE, "")), F.lit("")).alias("description"),
        F.when(F.col("source") == "src9", "test").otherwise("train").alias("split"),
        "lang",
    )
    return titled.select(
        "product_id", "title", "description",
        F.lower(word_slice("title", 3, 4)).alias("short_query"),
        "split", "lang",
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products × three deterministic text generators, written as expressions.

    The word array is a column of its own, so it is built once per product.
    """
    base = products(spark, sf_dir).withColumn("input_text", joined_for_evaluation(TEXT_COLS))
    n = F.size("_words")
    picked = {
        "lead": F.slice("_words", 1, 2 + n % 6),
        "mid": F.slice("_words", 4, 1 + n % 5),
        "tail": F.slice("_words", F.greatest(n - 3, F.lit(1)), 4),
    }
    candidates = F.array(
        *[
            F.struct(
                F.lit(i).alias("model_ord"),
                F.lit(f"org/{name}").alias("model_path"),
                F.lit(name).alias("model"),
                F.array_join(picked[name], " ").alias("generated_output"),
            )
            for i, name in enumerate(MODELS)
        ]
    )
    generated = base.withColumn("_words", words("input_text")).select("*", F.inline(candidates))
    return generated.drop("_words")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result table of the three generators before scoring, for queries that read no score."""
    return generations(spark, sf_dir).select(
        "product_id", "title", "description", "input_text",
        sentence_newlines("short_query").alias("target_query"),
        "model", "generated_output",
        (F.col("product_id") * len(MODELS) + F.col("model_ord")).alias("row_ord"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored result table of the three generators."""
    return with_rouge_scores(outputs(spark, sf_dir), sentence_newlines("generated_output"), "target_query")


def dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns paired with the whole text of the turn that follows."""
    turns = read_table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.select(
        "conv_id", "turn", "role",
        F.col("text").alias("pred"), F.lead("text").over(w).alias("ref"),
    )
    return paired.where((F.col("role") == "user") & F.col("ref").isNotNull()).select(
        "conv_id", "turn", "pred", "ref"
    )


def vec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring embeddings side by side."""
    vectors = read_table(spark, sf_dir, "embeddings")
    left = vectors.select("vec_id", F.col("embedding").alias("a"), "label")
    right = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return left.join(right, "vec_id")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse training-log records of two runs with equal steps, one per event."""
    events = read_table(spark, sf_dir, "events")
    final = F.col("event_id") % 50 == 49
    is_train = F.col("event_type").isin("click", "view", "error")
    kinds = events.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("run"), F.floor(F.col("event_id") / 3) % 2).alias("run"),
        F.floor(F.col("event_id") / 6).cast("bigint").alias("step"),
        "value", "user_id",
        F.when(final, "final").when(is_train, "train").otherwise("eval").alias("kind"),
    )
    train, evaluation = F.col("kind") == "train", F.col("kind") == "eval"
    known = {
        "loss": F.when(train, F.col("value")),
        "grad_norm": F.when(train & (F.col("seq") % 2 == 0), F.col("value") / 10),
        "learning_rate": F.when(train, F.lit(0.001)),
        "eval_loss": F.when(evaluation, F.col("value")),
        "eval_rougeL": F.when(evaluation, (F.col("user_id") % 101).cast("double")),
        "train_runtime": F.when(F.col("kind") == "final", F.col("value")),
    }
    missing = F.lit(None).cast("double")
    return kinds.select(
        "seq", "ts", "run", (F.col("step") / 100).alias("epoch"), "step",
        *[known.get(c, missing).alias(c) for c in [*TRAIN_KEYS, *EVAL_KEYS, *FINAL_KEYS]],
    )
