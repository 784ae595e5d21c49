"""Metric logs of training runs: merged rows per step and final rows per run.

A log is a folder.  Batch jobs add files to it; each micro-batch of a stream has
a folder of its own below it, so that writing the batch again replaces it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns and timestamp format of the two logs.
TRAIN_KEYS = ["loss", "grad_norm", "learning_rate"]
EVAL_KEYS = [
    "eval_loss", "eval_rouge1", "eval_rouge2", "eval_rougeL", "eval_rougeLsum",
    "eval_runtime", "eval_samples_per_second", "eval_steps_per_second",
]
FINAL_KEYS = [
    "train_runtime", "train_samples_per_second", "train_steps_per_second", "train_loss",
]
MERGED_COLUMNS = ["run", "epoch", "step", *TRAIN_KEYS, *EVAL_KEYS]
FINAL_COLUMNS = ["run", *FINAL_KEYS, "epoch", "step"]
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

LOG_SCHEMA = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType()),
     T.StructField("run", T.StringType()),
     T.StructField("epoch", T.DoubleType()), T.StructField("step", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in [*TRAIN_KEYS, *EVAL_KEYS, *FINAL_KEYS]]
)


def write_time() -> Column:
    """Time of writing as text."""
    return F.date_format(F.current_timestamp(), TIMESTAMP_FORMAT).alias("timestamp")


def with_run(logs: DataFrame) -> DataFrame:
    """Logs of one run may leave its name out: it is null then."""
    return logs if "run" in logs.columns else logs.withColumn("run", F.lit(None).cast("string"))


LOGS = {"evaluation_metrics": MERGED_COLUMNS, "final_metrics": FINAL_COLUMNS}
FORMATS = ("parquet", "csv")


def _log_path(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def _write(log: DataFrame, name: str, path: str, mode: str, fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown log format: {fmt}")
    log.select(write_time(), *LOGS[name]).write.mode(mode).option("header", "true").format(fmt).save(path)


def write_metric_logs(
    merged: DataFrame, final: DataFrame, path: str, mode: str = "append", fmt: str = "parquet"
) -> None:
    """Append both logs below ``path`` as Parquet or CSV; each carries its own full schema."""
    for log, name in ((merged, "evaluation_metrics"), (final, "final_metrics")):
        _write(log, name, _log_path(path, name), mode, fmt)


def batch_writer(path: str, writer: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function that writes both logs of a stream below ``path``.

    A batch holds rows of both logs, told apart by ``log``.  It is written to
    folders named by ``writer`` and the batch's number, replacing what an
    interrupted attempt left there: a batch that is written again adds no row.
    The rows are computed once for both logs.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown log format: {fmt}")
    stream = f"stream-{hashlib.sha256(writer.encode()).hexdigest()[:16]}"

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            present = {row["log"] for row in rows.select("log").distinct().collect()}
            for name in sorted(present):
                target = f"{_log_path(path, name)}/{stream}/batch-{number:010d}"
                _write(rows.where(F.col("log") == name), name, target, "overwrite", fmt)
        finally:
            rows.unpersist()

    return write


def read_metric_log(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One of the two logs, whether jobs or streams have written it; empty where nothing was written."""
    types = {field.name: field.dataType for field in LOG_SCHEMA}
    schema = T.StructType(
        [T.StructField("timestamp", T.StringType()), *(T.StructField(c, types[c]) for c in LOGS[name])]
    )
    folder = _log_path(path, name)
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true").option("header", "true")
    try:
        return reader.format(fmt).load(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
