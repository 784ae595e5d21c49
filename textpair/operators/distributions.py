"""Histograms, densities and correlations of scores.

Every distribution first counts rows per distinct value, with partial counts
before the shuffle, and works on those counts.  Scores have two decimals and
similarities six, so their cost then no longer depends on the number of rows;
values of any other precision stay spread over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpair.functions.rouge import SCORE_COLUMNS
from textpair.operators.compare import model_pair_filter, scores_long

# Bins of the score and similarity histograms, points of a
# density curve and how many bandwidths it reaches past the data.
SCORE_BINS = 20
SIMILARITY_BINS = 25
GRID_POINTS = 200
GRID_REACH = 3.0
# A value adds to the grid points within this many bandwidths.  What is left out
# is below exp(-32) = 1.3e-14 of a kernel's height at every point.
KERNEL_REACH = 8.0

_GROUP = ["model", "metric"]


def value_counts(long: DataFrame) -> DataFrame:
    """Rows per (model, metric, value); missing values and NaN are left out."""
    present = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return present.groupBy(*_GROUP, "value").agg(F.count(F.lit(1)).alias("n"))


def _with_group_facts(counted: DataFrame, facts: DataFrame) -> DataFrame:
    """``counted`` with the columns of ``facts``, which has one row per (model, metric).

    That is as many rows as models are compared, times the metrics, so the table
    is sent to the tasks and the values of a large group need not meet in one.
    """
    named = facts.withColumnsRenamed({c: f"_{c}" for c in _GROUP})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _GROUP]
    return counted.join(F.broadcast(named), same).drop(*[f"_{c}" for c in _GROUP])


def histogram(long: DataFrame, bins: int) -> DataFrame:
    """Equal-width bins per (model, metric): ``(model, metric, bin, lo, hi, n)``.

    Bins run from the smallest to the largest value, the last one closed.  If
    all values are equal the range is widened by half on both sides.  Empty
    bins are part of the result.
    """
    counted = value_counts(long)
    ends = counted.groupBy(*_GROUP).agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
    ranged = _with_group_facts(counted, ends)
    pad = F.when(F.col("_min") == F.col("_max"), F.lit(0.5)).otherwise(F.lit(0.0))
    ranged = ranged.withColumns({"_lo": F.col("_min") - pad, "_hi": F.col("_max") + pad})
    place = F.floor((F.col("value") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))) + 1
    placed = ranged.groupBy(*_GROUP, "_lo", "_hi", F.least(place, F.lit(bins)).cast("int").alias("bin")).agg(
        F.sum("n").alias("n")
    )
    filled = placed.groupBy(*_GROUP, "_lo", "_hi").agg(
        *[F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("n"))), F.lit(0)).alias(f"_n{b}") for b in range(1, bins + 1)]
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    rows = F.array(
        *[
            F.struct(
                F.lit(b).alias("bin"),
                F.round(F.col("_lo") + width * (b - 1), 6).alias("lo"),
                F.round(F.col("_lo") + width * b, 6).alias("hi"),
                F.col(f"_n{b}").alias("n"),
            )
            for b in range(1, bins + 1)
        ]
    )
    return filled.select(*_GROUP, F.inline(rows))


def score_histogram(
    df: DataFrame,
    models: Sequence[str],
    metrics: Sequence[str] = tuple(SCORE_COLUMNS),
    bins: int = SCORE_BINS,
) -> DataFrame:
    """Histogram of each score for the two compared models."""
    return histogram(scores_long(model_pair_filter(df, models), ["model"], metrics), bins)


def similarity_histogram(
    df: DataFrame, model: str, column: str = "semantic_similarity", bins: int = SIMILARITY_BINS
) -> DataFrame:
    """Histogram of one model's similarities."""
    return histogram(scores_long(df.where(F.col("model") == model), ["model"], [column]), bins)


def density(
    long: DataFrame,
    grid: int = GRID_POINTS,
    reach: float = GRID_REACH,
    count_scale_bins: int | None = None,
) -> DataFrame:
    """Gaussian kernel density per (model, metric): ``(model, metric, x, density)``.

    Bandwidth is Scott's rule, sample deviation times ``n ** (-1/5)``; the
    curve has ``grid`` points from ``reach`` bandwidths below the smallest to
    ``reach`` above the largest value.  With ``count_scale_bins`` the curve is
    scaled to the counts of a histogram with that many bins.  A metric without
    spread has no curve.
    """
    n, v = F.col("n"), F.col("value")
    counted = value_counts(long)
    moments = counted.groupBy(*_GROUP).agg(
        F.sum("n").cast("double").alias("_n"),
        F.sum(n * v).alias("_s1"),
        F.sum(n * v * v).alias("_s2"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
    )
    usable = moments.where((F.col("_n") > 1) & (F.col("_max") > F.col("_min")))
    variance = (F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_n")) / (F.col("_n") - 1)
    shaped = usable.withColumn("_h", F.sqrt(variance) * F.pow("_n", F.lit(-0.2)))
    lo = F.col("_min") - F.col("_h") * reach
    hi = F.col("_max") + F.col("_h") * reach
    facts = shaped.select(*_GROUP, "_n", "_min", "_max", "_h", lo.alias("_lo"), hi.alias("_hi"))
    h, last = F.col("_h"), F.lit(grid - 1)
    x = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_i") / last

    # Points in reach of a value; one more on both sides covers the rounding of the division.
    place = (v - F.col("_lo")) * last / (F.col("_hi") - F.col("_lo"))
    around = h * KERNEL_REACH * last / (F.col("_hi") - F.col("_lo"))
    first_point = F.greatest(F.floor(place - around) - 1, F.lit(0))
    last_point = F.least(F.ceil(place + around) + 1, last)
    z = (x - v) / h
    bump = n * F.exp(-0.5 * z * z) / (F.col("_n") * h * math.sqrt(2 * math.pi))
    if count_scale_bins is not None:
        bump = bump * F.col("_n") * (F.col("_max") - F.col("_min")) / count_scale_bins
    # Few values may share a partition, but each makes many rows.
    cores = long.sparkSession.sparkContext.defaultParallelism
    near = _with_group_facts(counted, facts).repartition(cores).where(first_point <= last_point)
    bumps = near.withColumn("_i", F.explode(F.sequence(first_point, last_point))).select(
        *_GROUP, "_i", x.alias("_x"), bump.alias("density")
    )
    # Every point of the curve is a row, also one that no value reaches.
    points = facts.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).select(
        *_GROUP, "_i", x.alias("_x"), F.lit(0.0).alias("density")
    )
    return (
        bumps.unionByName(points)
        .groupBy(*_GROUP, "_i", "_x")
        .agg(F.sum("density").alias("density"))
        .select(*_GROUP, F.round("_x", 6).alias("x"), F.round("density", 6).alias("density"))
    )


def score_density(
    df: DataFrame,
    models: Sequence[str],
    metrics: Sequence[str] = tuple(SCORE_COLUMNS),
    grid: int = GRID_POINTS,
    reach: float = GRID_REACH,
) -> DataFrame:
    """Density of each score for the two compared models."""
    return density(scores_long(model_pair_filter(df, models), ["model"], metrics), grid, reach)


def histogram_overlay(
    df: DataFrame,
    models: Sequence[str],
    metrics: Sequence[str] = tuple(SCORE_COLUMNS),
    bins: int = SCORE_BINS,
) -> DataFrame:
    """The curve drawn over a score histogram: no reach past the data, count scale."""
    long = scores_long(model_pair_filter(df, models), ["model"], metrics)
    return density(long, reach=0.0, count_scale_bins=bins)


def similarity_vs_rouge(
    df: DataFrame, model: str, column: str = "semantic_similarity"
) -> tuple[DataFrame, DataFrame]:
    """One model's (similarity, score) pairs per metric, and their correlation."""
    rows = df.where(F.col("model") == model).select(F.col(column).alias("similarity"), *SCORE_COLUMNS)
    pairs = scores_long(rows, ["similarity"])
    present = pairs.where(
        F.col("similarity").isNotNull() & F.col("value").isNotNull()
        & ~F.isnan("similarity") & ~F.isnan("value")
    )
    # Written out, because the built-in correlation fails on a constant score
    # under ANSI rules; here such a score has no correlation.
    spread = F.stddev_pop("similarity") * F.stddev_pop("value")
    corr = F.try_divide(F.covar_pop("similarity", "value"), spread)
    return pairs, present.groupBy("metric").agg(corr.alias("corr"))
