"""Reproducible samples and per-split heads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Digits of the hash by which rows are counted in one step of ``seeded_sample``.
STEP_DIGITS = 4
HASH_DIGITS = 32


def first_rows(
    df: DataFrame, order: Sequence[Column], n: int, per: Sequence[str] = ()
) -> DataFrame:
    """First ``n`` rows by ``order``, optionally per group.

    Without groups every task keeps its own first ``n`` and those are merged.
    With groups the same is done in two steps: first per group and input
    partition, so a group holding most of the table never passes through one
    task whole.
    """
    per = list(per)
    if not per:
        return df.orderBy(*order).limit(n)
    spread = Window.partitionBy(*per, "_part").orderBy(*order)
    final = Window.partitionBy(*per).orderBy(*order)
    kept = (
        df.withColumn("_part", F.spark_partition_id())
        .withColumn("_rn", F.row_number().over(spread))
        .where(F.col("_rn") <= n)
        .drop("_part", "_rn")
    )
    return kept.withColumn("_rn", F.row_number().over(final)).where(F.col("_rn") <= n).drop("_rn")


def dev_head(df: DataFrame, n: int = 100, key: str = "product_id", split: str = "split") -> DataFrame:
    """First ``n`` rows of each split by key."""
    return first_rows(df, [F.col(key)], n, [split])


def seeded_sample(
    df: DataFrame, n: int | None, seed: int = 42, key: str = "product_id"
) -> DataFrame:
    """``n`` rows chosen by a seeded hash of the key; no ``n`` means all rows.

    The choice depends on seed and key only, not on partitioning.  The rows
    are those with the ``n`` smallest hashes.  The n-th smallest is found on
    the keys alone: rows are counted by the first digits of their hash, then
    inside the boundary bucket by the next digits, until no bucket is cut or
    the hash has no more digits; the driver sees at most 16**4 counts per step.
    The sample is then one filter on the table, without a shuffle.  Of rows
    that share the boundary hash (equal keys) as many as are missing are taken.
    """
    if not n:
        return df
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary"))
    hashes = df.select(digest.alias("_hash"))
    prefix, missing = "", n
    while len(prefix) < HASH_DIGITS:
        size = len(prefix) + STEP_DIGITS
        inside = hashes.where(F.col("_hash").startswith(prefix)) if prefix else hashes
        counts = inside.groupBy(F.substring("_hash", 1, size).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        for row in counts.orderBy("_p").collect():
            if row["_n"] >= missing:
                prefix, whole = row["_p"], row["_n"] == missing
                break
            missing -= row["_n"]
        else:
            return df
        if whole:
            return df.where(F.substring(digest, 1, size) <= prefix)
    below = df.where(digest < prefix)
    return below.unionByName(df.where(digest == prefix).limit(missing))
