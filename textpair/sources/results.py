"""Result tables: one row per (example, model).

Parquet is the primary format.  CSV exists for exchange: its cells hold line
breaks, so Spark's own reader cannot split a CSV file.  It is written as many
files of bounded row count, and files of any size are read by byte ranges.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpair.functions.rouge import SCORE_COLUMNS
from textpair.sources.csv_ranges import read_csv_ranges

ROWS_PER_CSV_FILE = 200_000
# Endings of files that cannot be read from the middle.
COMPRESSED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")

_CSV = {"header": "true", "quote": '"', "escape": '"'}
# A missing value is written as nothing, an empty text as two quotes.  Reading
# keeps the two apart only if the null marker is not the empty text itself.
_CSV_READ = {**_CSV, "multiLine": "true", "nullValue": "\\N"}

# Columns that lead a result table where they are known: the example's key and
# the place of the model among those evaluated, by which reports order models.
KEY_TYPES = {"product_id": T.LongType(), "model_ord": T.IntegerType(), "row_ord": T.LongType()}


def result_schema(text_cols: Sequence[str], keys: Sequence[str] = ("product_id", "model_ord")) -> T.StructType:
    """Schema of a result table with the given key and input columns."""
    texts = [*text_cols, "input_text", "target_query", "model", "generated_output"]
    fields = [T.StructField(c, KEY_TYPES.get(c, T.StringType())) for c in keys]
    fields += [T.StructField(c, T.StringType()) for c in texts]
    fields += [T.StructField(c, T.DoubleType()) for c in SCORE_COLUMNS]
    return T.StructType(fields)


def _write_csv(df: DataFrame, path: str, mode: str, compression: str = "none") -> None:
    (
        df.write.mode(mode)
        .options(
            **_CSV,
            ignoreLeadingWhiteSpace="false",
            ignoreTrailingWhiteSpace="false",
            maxRecordsPerFile=str(ROWS_PER_CSV_FILE),
            compression=compression,
        )
        .csv(path)
    )


def write_results(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", compression: str | None = None
) -> None:
    """Append a result table; Parquet is partitioned by model.

    A row holds its texts twice and stands once per model, so ``compression``
    counts: Parquet has ``zstd`` by default, CSV none.  Compressed CSV files
    (``gzip``) take a quarter of the space or less, but are read by one task each.
    """
    if fmt == "parquet":
        df.write.mode(mode).partitionBy("model").parquet(path, compression=compression or "zstd")
    elif fmt == "csv":
        _write_csv(df, path, mode, compression or "none")
    else:
        raise ValueError(f"unknown result format: {fmt}")


def read_results(
    spark: SparkSession,
    path: str,
    text_cols: Sequence[str],
    fmt: str = "csv",
    keys: Sequence[str] = ("product_id", "model_ord"),
    by_range: bool = True,
) -> DataFrame:
    """Read a result table by column names.

    Further columns of the files are left out; a column that is not there, or
    CSV files whose headers differ, are an error.  A large CSV file is read by
    many tasks; with ``by_range=False`` one task reads each file, which also
    takes files with stray quotes inside unquoted cells.  One task reads each
    file, too, where some of them are compressed.
    """
    schema = result_schema(text_cols, keys)
    if fmt == "parquet":
        return _chosen(spark.read.parquet(path), schema)
    if fmt == "csv":
        # The header gives names and order; every cell is read as text first.
        named = spark.read.options(**_CSV_READ, enforceSchema="false").csv(path)
        if by_range and not any(f.endswith(COMPRESSED) for f in named.inputFiles()):
            return _chosen(read_csv_ranges(spark, path, named.columns, _CSV_READ), schema)
        full = T.StructType([T.StructField(c, T.StringType()) for c in named.columns])
        cells = spark.read.schema(full).options(**_CSV_READ, enforceSchema="false").csv(path)
        return _chosen(cells, schema)
    raise ValueError(f"unknown result format: {fmt}")


def _chosen(df: DataFrame, schema: T.StructType) -> DataFrame:
    missing = [c for c in schema.names if c not in df.columns]
    if missing:
        raise ValueError(f"the result table has no column {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def write_case_slices(
    slices: Mapping[str, DataFrame], path: str, names: Iterable[str] | None = None
) -> list[str]:
    """Write the chosen slices (default: all) as CSV folders; returns their paths."""
    chosen = list(slices) if names is None else list(names)
    written = []
    for name in chosen:
        target = f"{path.rstrip('/')}/{name}"
        _write_csv(slices[name], target, "overwrite")
        written.append(target)
    return written


def read_slice(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read one slice back."""
    return spark.read.schema(schema).options(**_CSV_READ).csv(path)
