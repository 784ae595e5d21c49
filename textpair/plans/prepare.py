"""Preparation of training data: join, tokenise, truncate, keep derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from textpair.operators.curate import concat_input_train
from textpair.operators.sampling import dev_head
from textpair.operators.vocab import MAX_INPUT, MAX_LABEL, encode_tokens


def prepare_dataset(
    df: DataFrame,
    vocab: DataFrame,
    cols: Sequence[str] = ("title", "description"),
    label: str = "short_query",
    key: str = "product_id",
    max_input: int = MAX_INPUT,
    max_label: int = MAX_LABEL,
    dev: bool = False,
) -> DataFrame:
    """Encoded dataset; ``dev`` keeps the first 100 rows of each split."""
    chosen = dev_head(df, 100, key) if dev else df
    joined = concat_input_train(chosen, cols)
    return encode_tokens(joined, vocab, "input_text", label, key, max_input, max_label)
