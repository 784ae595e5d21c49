"""Averages per model, per output length and per corpus."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpair.functions.rouge import SCORE_COLUMNS, with_rouge_f
from textpair.functions.text import word_count

# Resamples and reported percentiles of the bootstrap.
RESAMPLES = 1000
PERCENTILES = {"low": 0.025, "mid": 0.5, "high": 0.975}
# Draws are numbers below this prime.
PRIME = 2**31 - 1


def _mean(c: str, where: Column | None = None) -> Column:
    """Mean over the values present; NaN counts as missing.

    Scores have two decimals: their hundredths are added up exactly and divided
    once, so the mean is the same in any order of rows.  Where any value is not
    a whole number of hundredths the plain mean is taken.
    """
    present = ~F.isnan(c) if where is None else where & ~F.isnan(c)
    value = F.when(present, F.col(c))
    hundredths = F.round(value * 100).cast("bigint")
    exact = F.try_divide(F.sum(hundredths).cast("double"), F.count(hundredths) * F.lit(100.0))
    return F.when(F.every(value.eqNullSafe(hundredths / F.lit(100.0))), exact).otherwise(F.avg(value))


def avg_scores_by_model(df: DataFrame, score_cols: Sequence[str] = tuple(SCORE_COLUMNS)) -> DataFrame:
    """Mean of every score per model, over all models."""
    return (
        df.where(F.col("model").isNotNull())
        .groupBy("model")
        .agg(*[_mean(c).alias(f"{c}_avg") for c in score_cols])
    )


def avg_scores_by_size(df: DataFrame, model: str) -> DataFrame:
    """Mean scores per output length in words, ordered by length."""
    return (
        df.where(F.col("model") == model)
        .groupBy(word_count("generated_output").alias("size"))
        .agg(*[_mean(c).alias(f"{c}_avg") for c in SCORE_COLUMNS])
        .orderBy("size")
    )


def size_score_diff(averages: DataFrame) -> DataFrame:
    """Change of each average against the next shorter length; the first is 0.

    The input has one row per distinct length, so the window is over at most
    as many rows as the longest output has words.
    """
    w = Window.orderBy("size")
    diffs = {
        f"{c}_diff": F.coalesce(F.col(f"{c}_avg") - F.lag(f"{c}_avg").over(w), F.lit(0.0))
        for c in SCORE_COLUMNS
    }
    return averages.withColumns(diffs)


def output_length_range(df: DataFrame, model: str) -> DataFrame:
    """Longest and shortest output of one model in words."""
    n = word_count("generated_output")
    return df.where(F.col("model") == model).agg(
        F.max(n).alias("max_words"), F.min(n).alias("min_words")
    )


def models_in_order(df: DataFrame, order: str = "row_ord") -> DataFrame:
    """Distinct models by first appearance."""
    return df.groupBy("model").agg(F.min(order).alias("ord")).orderBy("ord")


def select_model_pair(models: DataFrame, compare_models: Sequence[int] = (0, 1)) -> tuple[str, str]:
    """The two models to compare.

    Two models: both.  More: those at the configured positions of the list of
    all names, counted from its end where negative.
    """
    names = [row["model"] for row in models.orderBy("ord").collect()]
    if len(names) < 2:
        raise ValueError("at least two models are needed")
    first, second = compare_models if len(names) > 2 else (0, 1)
    return names[first], names[second]


def model_gap(df: DataFrame, first: str, second: str) -> DataFrame:
    """Average of two models per metric and their difference, largest first."""
    per_model = (
        df.where(F.col("model").isin(first, second))
        .groupBy()
        .agg(
            *[
                _mean(c, F.col("model") == m).alias(f"{c}_{i}")
                for c in SCORE_COLUMNS
                for i, m in ((1, first), (2, second))
            ]
        )
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("metric"),
                F.col(f"{c}_1").alias("avg1"),
                F.col(f"{c}_2").alias("avg2"),
                (F.col(f"{c}_1") - F.col(f"{c}_2")).alias("gap"),
            )
            for c in SCORE_COLUMNS
        ]
    )
    return per_model.select(F.inline(rows)).orderBy(F.desc("gap"), "metric")


def corpus_rouge(df: DataFrame, pred: str = "pred", ref: str = "ref", stem: bool = False) -> DataFrame:
    """Mean F of the four scores over all pairs, percent with four decimals."""
    scored = with_rouge_f(df, pred, ref, stem)
    return scored.agg(*[F.bround(F.avg(c) * 100, 4).alias(c) for c in SCORE_COLUMNS])


def _poisson_thresholds() -> list[float]:
    """Cumulative probabilities of a Poisson(1) count of 0, 1, ..., as far as a draw can tell them from 1."""
    total, out, k = 0.0, [], 0
    while 1 - total >= 0.5 / PRIME:
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
        k += 1
    return out


def _resample_batches(resamples: int, seed: int):
    """Partial sums of every resample: one row per task and resample."""
    words = [hashlib.md5(f"{seed}:{b}".encode()).hexdigest() for b in range(resamples)]
    factors = np.array([1 + int(w[:8], 16) % (PRIME - 1) for w in words], np.int64)
    terms = np.array([int(w[8:16], 16) % PRIME for w in words], np.int64)
    thresholds = np.array(_poisson_thresholds())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = counts = None
        for batch in batches:
            units = batch.column("_unit").to_numpy()
            scores = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)], 1)
            scores = scores.astype(np.float64)
            valid = ~np.isnan(scores)
            scores = np.where(valid, scores, 0.0)
            if sums is None:
                sums, counts = np.zeros((resamples, scores.shape[1])), np.zeros((resamples, scores.shape[1]))
            for start in range(0, len(units), 1000):
                draws = (units[start : start + 1000, None] * factors + terms) % PRIME / PRIME
                weights = np.searchsorted(thresholds, draws, side="right").astype(np.float64).T
                sums += weights @ scores[start : start + 1000]
                counts += weights @ valid[start : start + 1000]
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(resamples), pa.int32()), pa.array(list(sums), pa.list_(pa.float64())),
                    pa.array(list(counts), pa.list_(pa.float64())),
                ],
                names=["_b", "_sums", "_counts"],
            )

    return run


def corpus_rouge_bootstrap(
    df: DataFrame,
    key: str,
    score_cols: Sequence[str] = tuple(SCORE_COLUMNS),
    resamples: int = RESAMPLES,
    seed: int = 42,
) -> DataFrame:
    """Percentiles of the resampled mean per metric: ``(metric, low, mid, high)``.

    A Poisson bootstrap: every resample gives each row a Poisson(1) weight,
    drawn from a universal hash of the row's key, one function per resample, so
    the result does not depend on partitioning.  A task adds up all resamples
    of its rows; only ``resamples`` rows per task are shuffled.
    """
    score_cols = list(score_cols)
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary"))
    unit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % PRIME
    values = [F.when(~F.isnan(c), F.col(c)).cast("double").alias(f"_v{i}") for i, c in enumerate(score_cols)]
    partial = df.select(unit.alias("_unit"), *values).mapInArrow(
        _resample_batches(resamples, seed), "_b int, _sums array<double>, _counts array<double>"
    )
    means = partial.groupBy("_b").agg(
        *[F.try_divide(F.sum(F.col("_sums")[i]), F.sum(F.col("_counts")[i])).alias(c) for i, c in enumerate(score_cols)]
    )
    long = means.unpivot(["_b"], score_cols, "metric", "_mean")
    points = F.percentile("_mean", F.array(*[F.lit(p) for p in PERCENTILES.values()]))
    summary = long.groupBy("metric").agg(points.alias("_points"))
    return summary.select(
        "metric", *[F.round(F.col("_points")[i], 4).alias(name) for i, name in enumerate(PERCENTILES)]
    )
