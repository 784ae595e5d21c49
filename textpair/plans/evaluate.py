"""Evaluation: every model on every example, scored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpair.functions.rouge import SCORE_COLUMNS, with_rouge_scores
from textpair.functions.text import as_text, joined_for_evaluation, sentence_newlines
from textpair.operators.curate import stringify_metadata
from textpair.operators.generate import BATCH_SIZE, Generator, batch_generate
from textpair.operators.sampling import seeded_sample


def evaluate_models(
    df: DataFrame,
    models: Mapping[str, Generator],
    cols: Sequence[str] = ("title", "description"),
    label: str = "short_query",
    sample: int | None = None,
    seed: int = 42,
    key: str = "product_id",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Result table: key, input columns, input, target, model, output, four scores.

    The stored target has one sentence per line, the stored output is as
    generated; scoring uses the output with one sentence per line.  Targets are
    prepared before rows are multiplied by models.  Without a sample there is
    no shuffle; also works on a stream then.
    """
    examples = seeded_sample(df, sample, seed, key)
    prepared = stringify_metadata(
        examples.select(
            key,
            *[c for c in cols if c in df.columns],
            joined_for_evaluation(cols).alias("input_text"),
            sentence_newlines(as_text(label)).alias("target_query"),
        ),
        cols,
    )
    generated = batch_generate(prepared, models, batch_size)
    scored = with_rouge_scores(generated, sentence_newlines("generated_output"), "target_query")
    return scored.select(
        key, *cols, "input_text", "target_query", "model_ord", "model", "generated_output",
        *[F.col(c) for c in SCORE_COLUMNS],
    )
