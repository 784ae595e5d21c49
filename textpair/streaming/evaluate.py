"""Scoring examples as they arrive, and running a stream to its end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textpair.operators.generate import BATCH_SIZE, Generator
from textpair.plans.evaluate import evaluate_models


def stream_evaluate(
    examples: DataFrame,
    models: Mapping[str, Generator],
    cols: Sequence[str] = ("title", "description"),
    label: str = "short_query",
    key: str = "product_id",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Scored rows of an example stream; stateless, so append mode needs no state."""
    return evaluate_models(examples, models, cols, label, None, 0, key, batch_size)


def append_available(
    stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()
) -> StreamingQuery:
    """Append everything available now to Parquet, exactly once; waits for the end."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start(path)
    query.awaitTermination()
    return query
