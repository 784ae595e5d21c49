"""Labelled text datasets stored as Parquet, with the split as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a dataset partitioned by split, so one split reads its files alone."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def load_split(
    spark: SparkSession, path: str, split: str, subset: str | None = None
) -> DataFrame:
    """Rows of one named split, optionally of a named subset folder."""
    source = f"{path.rstrip('/')}/{subset}" if subset else path
    return spark.read.parquet(source).where(F.col("split") == split)


def split_profile(df: DataFrame, batch_size: int = 32) -> DataFrame:
    """Rows, columns and steps per epoch of every split."""
    n_columns = len(df.columns)
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "split",
        "n_rows",
        F.lit(n_columns).alias("n_columns"),
        F.greatest(F.lit(1), F.floor(F.col("n_rows") / batch_size)).cast("bigint").alias("steps_per_epoch"),
    )
