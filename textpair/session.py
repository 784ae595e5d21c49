"""Session settings the library is tuned for.

Nothing in the library needs these settings to be correct; they only decide
how fast and how safely a plan runs.  ``configure`` touches runtime settings
alone, so it can be applied to a session somebody else created.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

# Runtime settings: adaptive re-planning turns shuffled joins into broadcast
# joins only after the small side's real size is known, and splits hot
# partitions of the joins that stay shuffled.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.maxConcurrentOutputFileWriters": "16",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python in batches of so many rows; it bounds what a worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def open_writers(spark: SparkSession, files: int = 16) -> None:
    """Let a task write so many partitions side by side; Spark sorts its whole rows only where there are more."""
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", str(files))


def get_session(app_name: str = "textpair", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the recommended settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path every executor can reach, below ``spark.checkpoint.dir``.

    Only a session whose driver and tasks are one process (``local[n]``), as in
    tests, may leave that setting out and gets a temporary folder.  Anywhere
    else each machine would write to a disk of its own, so that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark``.

    Needed once per application when the package is not installed on the
    executors and was not given with ``--py-files``.
    """
    context = spark.sparkContext
    if getattr(context, "_textpair_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="run-")) / "textpair.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._textpair_shipped = True


def frugal(run: Callable) -> Callable:
    """A batch function that gives its memory back to the machine when its task ends; the worker lives on."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
