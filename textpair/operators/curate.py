"""Building training and evaluation inputs from labelled text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpair.functions.text import as_text, joined_for_evaluation, joined_for_training
from textpair.functions.vectors import with_text_cosine

# Fixed value: a title-only row is kept when its similarity with the short
# query is above this.
SIMILARITY_THRESHOLD = 0.85


def concat_input_train(df: DataFrame, cols: Sequence[str], out: str = "input_text") -> DataFrame:
    """Add the training input: non-empty parts, blank line between, stripped."""
    return df.withColumn(out, joined_for_training(cols))


def concat_input_eval(df: DataFrame, cols: Sequence[str], out: str = "input_text") -> DataFrame:
    """Add the evaluation input: every part as text, missing ones visible."""
    return df.withColumn(out, joined_for_evaluation(cols))


def stringify_metadata(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Carry ``cols`` as text; an absent column becomes empty text."""
    present = set(df.columns)
    return df.withColumns({c: as_text(c) if c in present else F.lit("") for c in cols})


def drop_source_columns(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Keep only the derived columns."""
    return df.select(*keep)


def combine_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """One dataset with the split as a column."""
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test"))
    )


def curate_title_only(
    df: DataFrame, title: str = "title", label: str = "short_query", key: str = "product_id"
) -> DataFrame:
    """Variant ``T``: the title alone is the input."""
    return df.select(key, joined_for_training([title]).alias("input_text"), label)


def curate_title_description(
    df: DataFrame,
    cols: Sequence[str] = ("title", "description"),
    label: str = "short_query",
    key: str = "product_id",
) -> DataFrame:
    """Variant ``TD``: title and description are the input."""
    return df.select(key, joined_for_training(cols).alias("input_text"), label)


def with_title_similarity(
    df: DataFrame, title: str = "title", label: str = "short_query", out: str = "similarity"
) -> DataFrame:
    """Add the similarity of the title with the short query."""
    return with_text_cosine(df, title, label, out)


def similarity_filter(
    df: DataFrame, sim_col: str = "similarity", threshold: float = SIMILARITY_THRESHOLD
) -> DataFrame:
    """Rows whose similarity is above the threshold; NaN is not above it."""
    return df.where(~F.isnan(sim_col) & (F.col(sim_col) > threshold))


def language_alignment_filter(
    df: DataFrame, threshold: float, lang: str = "en", sim_col: str = "similarity",
    lang_col: str = "lang",
) -> DataFrame:
    """Rows in one language whose query is closely aligned with the description."""
    return df.where(
        (F.col(lang_col) == lang) & ~F.isnan(sim_col) & (F.col(sim_col) >= threshold)
    )


def _two_variants(df: DataFrame, cols, title, label, key, keep_title) -> DataFrame:
    """Both input forms of each row from one scan of ``df``."""
    both = F.struct(F.lit("TD").alias("variant"), joined_for_training(cols).alias("input_text"))
    alone = F.struct(F.lit("T").alias("variant"), joined_for_training([title]).alias("input_text"))
    forms = F.array(both, alone)
    if keep_title is not None:
        forms = F.when(keep_title, forms).otherwise(F.array(both))
    return df.select(key, F.inline(forms), label)


def union_expanded(
    df: DataFrame,
    cols: Sequence[str] = ("title", "description"),
    title: str = "title",
    label: str = "short_query",
    key: str = "product_id",
) -> DataFrame:
    """Variant ``TDE``: every row with its description and once more without."""
    return _two_variants(df, cols, title, label, key, None)


def union_curated(
    df: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    sim_col: str | None = None,
    cols: Sequence[str] = ("title", "description"),
    title: str = "title",
    label: str = "short_query",
    key: str = "product_id",
) -> DataFrame:
    """Variant ``TDC``: all rows with description plus the similar title-only rows.

    ``sim_col`` names a similarity computed elsewhere; without it the built-in
    term-frequency similarity of title and short query is used.
    """
    if sim_col is None:
        sim_col = "_similarity"
        df = with_title_similarity(df, title, label, sim_col)
    above = F.coalesce(~F.isnan(sim_col) & (F.col(sim_col) > threshold), F.lit(False))
    return _two_variants(df, cols, title, label, key, above)
