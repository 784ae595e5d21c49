"""Slices of a result table and comparisons between two models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpair.functions.once import with_column_once
from textpair.functions.rouge import SCORE_COLUMNS

# Default thresholds of the best and worst slices.
BEST_SCORE = 50.0
WORST_SCORE = 0.0
# Rows one step of ``repeat_rows`` emits from a single array; Spark holds them all before the next step.
REPEAT_CHUNK = 1_000


def _number(c: str) -> Column:
    """The column with NaN turned into null, so comparisons reject it."""
    return F.when(~F.isnan(c), F.col(c))


def _percentage(c: str) -> Column:
    """The number, which must lie in 0 to 100."""
    outside = (_number(c) < 0) | (_number(c) > 100)
    return F.when(outside, F.raise_error(F.lit(f"{c} must be a percentage"))).otherwise(_number(c))


def model_pair_filter(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Rows of the two compared models."""
    if len(models) != 2:
        raise ValueError("exactly two models are needed for a comparison")
    return df.where(F.col("model").isin(*models))


def zero_score_rows(df: DataFrame, model: str) -> DataFrame:
    """Rows of one model whose four scores are all zero."""
    zero = F.lit(True)
    for c in SCORE_COLUMNS:
        zero = zero & (F.col(c) == 0)
    return df.where((F.col("model") == model) & zero)


def best_rows(df: DataFrame, model: str, score: float = BEST_SCORE) -> DataFrame:
    """Rows of one model with ROUGE-L at or above ``score``."""
    return df.where((F.col("model") == model) & (_number("rougeL") >= score))


def worst_rows(df: DataFrame, model: str, score: float = WORST_SCORE) -> DataFrame:
    """Rows of one model with ROUGE-L at or below ``score``."""
    return df.where((F.col("model") == model) & (_number("rougeL") <= score))


def scores_long(
    df: DataFrame, ids: Sequence[str] = ("model",), score_cols: Sequence[str] = tuple(SCORE_COLUMNS)
) -> DataFrame:
    """One row per (row, metric)."""
    return df.unpivot(list(ids), list(score_cols), "metric", "value")


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times.

    A row becomes one row per ``REPEAT_CHUNK`` copies; these are dealt to all
    tasks before they are multiplied, so a row with very many copies does not
    come from one task.
    """
    n = F.col(times)
    chunks = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / REPEAT_CHUNK).cast("int"))))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(tasks, *df.columns, "_chunk")
    left = F.least(F.lit(REPEAT_CHUNK), n - F.col("_chunk") * REPEAT_CHUNK).cast("int")
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), left))).drop("_chunk", "_copy", times)


def counted_sides(df: DataFrame, models: Sequence[str], groups: Sequence[str]) -> list[DataFrame]:
    """``(*groups, n)`` for each model: equal rows of a model are one.

    All sides read the same aggregate, so the rows below are computed and shuffled once.  A filter on a column made by
    a generator stays above it; pushed down, each side would have a plan, and a pass over the rows, of its own.  The
    filter on ``n``, which is always true, keeps the count in plans that do not use it, for the same reason.
    """
    counted = df.groupBy("model", *groups).agg(F.count(F.lit(1)).alias("n"))
    sided = counted.withColumn("_side", F.explode(F.array("model")))
    return [sided.where((F.col("_side") == model) & (F.col("n") > 0)).select(*groups, "n") for model in models]


def outperformed_rows(
    df: DataFrame,
    first: str,
    second: str,
    null_safe: bool = True,
    on: Sequence[str] = ("target_query",),
    counted: bool = False,
) -> DataFrame:
    """Pairs with equal target where ``first`` beats ``second`` on all four scores.

    Equal targets multiply, as in any many-to-many join, and the result keeps
    every pair; with ``counted`` equal pairs are one row and ``n`` is their
    number, which is the form to read at scale.  What keeps that affordable:

    * equal rows are counted before the join, so a group of copies is one row
      on each side and is multiplied back afterwards;
    * scores are percentages (others raise), so a row with a zero score cannot
      win and a row with a full score cannot lose; both leave before the shuffle.  Targets
      without any token, often the largest group, score zero and vanish here;
    * rows of other models leave before they are scored;
    * a target that stays hot is split by the adaptive skew join.
    """
    on = list(on)
    extra = [c for c in on if c != "target_query"]
    keys = ["target_query", *extra]

    def named(rows: DataFrame, name: str) -> DataFrame:
        columns = [*[F.col(k).alias(f"{name}_{k}") for k in keys], F.col("generated_output").alias(f"{name}_output")]
        columns += [F.col(c).alias(f"{name}_{c}") for c in SCORE_COLUMNS]
        return rows.select(*columns, F.col("n").alias(f"{name}_n"))

    can_win, can_lose = F.lit(True), F.lit(True)
    for c in SCORE_COLUMNS:
        can_win = can_win & (_percentage(c) > 0)
        can_lose = can_lose & (_percentage(c) < 100)
    # The plain test on the model, unlike the next, can move below the scoring.  That one reads each score many times,
    # so the scores are computed before it; inlined, they make more code than Spark compiles.
    scored = with_column_once(df.where(F.col("model").isin(first, second)), "_scores", F.struct(*SCORE_COLUMNS))
    scored = scored.withColumns({c: F.col("_scores")[c] for c in SCORE_COLUMNS}).drop("_scores")
    rows = scored.where(((F.col("model") == first) & can_win) | ((F.col("model") == second) & can_lose))
    sides = counted_sides(rows, (first, second), [*keys, "generated_output", *SCORE_COLUMNS])
    a, b = named(sides[0], "a"), named(sides[1], "b")

    match, wins = F.lit(True), F.lit(True)
    for k in on:
        x, y = F.col(f"a_{k}"), F.col(f"b_{k}")
        match = match & (x.eqNullSafe(y) if null_safe else x == y)
    for c in SCORE_COLUMNS:
        wins = wins & (F.col(f"a_{c}") > F.col(f"b_{c}"))
    pairs = a.join(b, match & wins).select(
        *[F.col(f"a_{k}").alias(k) for k in keys],
        F.col("a_output").alias(f"generated_output_{first}"),
        F.col("b_output").alias(f"generated_output_{second}"),
        (F.col("a_n") * F.col("b_n")).alias("n" if counted else "_times"),
    )
    return pairs if counted else repeat_rows(pairs, "_times")


def side_by_side_outputs(
    df: DataFrame, first: str, second: str, key: str = "product_id"
) -> DataFrame:
    """Target next to both models' outputs, one row per key.

    Two outputs of one model for a key are an error.
    """
    one = F.when(F.count(F.lit(1)) <= 1, F.max("generated_output")).otherwise(
        F.raise_error(F.lit("more than one output of a model for a key"))
    )
    wide = (
        model_pair_filter(df, [first, second])
        .groupBy(key, "target_query")
        .pivot("model", [first, second])
        .agg(one)
    )
    return wide.select(
        key, "target_query", F.col(first).alias("output_1"), F.col(second).alias("output_2")
    )
