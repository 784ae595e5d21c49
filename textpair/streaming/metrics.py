"""Metric logs as a stream: the keyed merge, and final records.

The state is the records that still wait for their other side.  For many keys use the RocksDB
state store (``textpair.session.RUNTIME_CONF`` sets it): a batch then costs what
arrives in it, not what is pending.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textpair.operators.checkpoints import EVAL_MARKS, KEY, TRAIN_MARKS, final_metrics
from textpair.sources.metric_logs import EVAL_KEYS, FINAL_COLUMNS, MERGED_COLUMNS, TRAIN_KEYS, batch_writer, with_run

_VALUES = [*TRAIN_KEYS, *EVAL_KEYS]
# A record's values travel as one array, because state functions pay per column,
# next to a bit mask of those present, because arrays in Python do not tell a
# missing value from NaN.  Its epoch and step travel as one text.
_RECORD = [
    T.StructField("key", T.StringType()), T.StructField("values", T.ArrayType(T.DoubleType())),
    T.StructField("mask", T.LongType()),
]
_STATE = T.StructType([T.StructField("pending", T.ArrayType(T.StructType([*_RECORD, T.StructField("until", T.LongType())])))])
_OUTPUT = T.StructType([T.StructField("run", T.StringType()), *_RECORD])
_TRAIN_BITS = sum(1 << _VALUES.index(c) for c in TRAIN_MARKS)
_EVAL_BITS = sum(1 << _VALUES.index(c) for c in EVAL_MARKS)
_NAN = float("nan")
# Consecutive steps of a run that share one state: calling a state function
# costs far more than folding a record.
STEPS_PER_STATE = 64


def _mask() -> Column:
    bits = F.lit(0).cast("long")
    for i, c in enumerate(_VALUES):
        bits = bits + F.when(F.col(c).isNotNull(), 1 << i).otherwise(0)
    return bits


def _value(i: int) -> Column:
    present = F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    return F.when(present, F.coalesce(F.col("values")[i], F.lit(_NAN)))


def _pending_processor(timed: bool) -> StatefulProcessor:
    """The merge with one state row per open key: a record reads and writes its own key alone.

    The class is made here so that workers get it by value.
    """

    class Pending(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.open = handle.getMapState("open", "key string", "values array<double>, mask long, until long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            watermark = timerValues.getCurrentWatermarkInMs() if timed else 0
            arrived: list[tuple] = []
            for frame in rows:
                arrived.extend(zip(*(frame[c].tolist() for c in ("seq", "millis", "name", "given", "present"))))
            arrived.sort(key=lambda record: record[0])
            touched: dict[str, tuple | None] = {}
            stored: set[str] = set()
            emitted: list[tuple] = []
            for _, millis, name, given, present in arrived:
                if name not in touched:
                    touched[name] = None
                    if self.open.containsKey((name,)):
                        stored.add(name)
                        values, mask, until = self.open.getValue((name,))
                        if not timed or until > watermark:
                            touched[name] = ([_NAN if v is None else v for v in values], mask, until)
                values, mask, until = touched[name] or ([_NAN] * len(_VALUES), 0, 0)
                for i in range(len(_VALUES)):
                    if present >> i & 1:
                        values[i] = _NAN if given[i] is None else float(given[i])
                mask |= present
                if mask & _TRAIN_BITS and mask & _EVAL_BITS:
                    emitted.append((key[0], name, values, mask))
                    touched[name] = None
                elif mask:
                    touched[name] = (values, mask, max(until, millis + 1, watermark + 1))
            for name, entry in touched.items():
                if entry:
                    self.open.updateValue((name,), entry)
                    if timed:
                        self.handle.registerTimer(entry[2])
                elif name in stored:
                    self.open.removeKey((name,))
            if emitted:
                yield pd.DataFrame(emitted, columns=_OUTPUT.names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            watermark = timerValues.getCurrentWatermarkInMs()
            for (name,), (_, _, until) in list(self.open.iterator()):
                if until <= watermark:
                    self.open.removeKey((name,))
            return iter(())

        def close(self) -> None:
            pass

    return Pending()


def stream_metrics_merge(logs: DataFrame, pending_days: int | None = None, per_key: bool = False) -> DataFrame:
    """Merged rows of a log stream; a key is forgotten when it has emitted.

    Records of one micro-batch are taken in ``seq`` order.  Incomplete keys are
    kept for ever, as in the batch merge, unless ``pending_days`` is given:
    then, in event time, a key still incomplete when records so much newer have
    arrived is dropped, and so is a record that arrives that late, and state is
    bounded by the keys of that period.

    A run's state is kept in blocks of steps, rewritten whole; cheapest where
    few keys are open.  ``per_key`` keeps every open key as a state row of its
    own (it needs the RocksDB store), for runs that log many steps before their
    other side comes.  Both give the same rows; a checkpoint stays with its form.
    """
    timed = pending_days is not None

    def merge(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs() if timed else 0
        pending: dict[str, tuple[list[float], int, int]] = {}
        if state.exists:
            for key, values, mask, until in state.get[0]:
                if not timed or until > watermark:
                    pending[key] = ([_NAN if v is None else v for v in values], mask, until)
        arrived: list[tuple] = []
        if not state.hasTimedOut:
            for frame in frames:
                arrived.extend(zip(*(frame[c].tolist() for c in ("seq", "millis", "name", "given", "present"))))
            arrived.sort(key=lambda record: record[0])
        emitted: list[tuple] = []
        for _, millis, key, given, present in arrived:
            values, mask, until = pending.get(key) or ([_NAN] * len(_VALUES), 0, 0)
            for i in range(len(_VALUES)):
                if present >> i & 1:
                    values[i] = _NAN if given[i] is None else float(given[i])
            mask |= present
            if mask & _TRAIN_BITS and mask & _EVAL_BITS:
                emitted.append((group[0], key, values, mask))
                pending.pop(key, None)
            elif mask:
                pending[key] = (values, mask, max(until, millis + 1, watermark + 1))
        if pending:
            state.update(([(key, *rest) for key, rest in pending.items()],))
            if timed:
                state.setTimeoutTimestamp(min(until for _, _, until in pending.values()))
        elif state.exists:
            state.remove()
        if emitted:
            yield pd.DataFrame(emitted, columns=_OUTPUT.names)

    marked = logs.withWatermark("ts", f"{pending_days} days") if timed else logs
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEY if c != "run"]
    open_records = (
        with_run(marked)
        .where(F.col("train_runtime").isNull())
        .select(
            "ts", F.unix_millis("ts").alias("millis"), "seq", "run", F.floor(F.col("step") / STEPS_PER_STATE).alias("steps"),
            F.concat_ws("|", *key).alias("name"), F.array(*_VALUES).alias("given"), _mask().alias("present"),
        )
    )
    grouped = open_records.groupBy("run", "steps")
    if per_key:
        merged = grouped.transformWithStateInPandas(
            _pending_processor(timed), _OUTPUT, "Append", "EventTime" if timed else "None"
        )
    else:
        merged = grouped.applyInPandasWithState(
            merge, _OUTPUT, _STATE, "append",
            GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout,
        )
    epoch, step = (F.nullif(F.split("key", "[|]")[i], F.lit("")) for i in range(2))
    return merged.select(
        "run", epoch.cast("double").alias("epoch"), step.cast("bigint").alias("step"),
        *[_value(i).alias(c) for i, c in enumerate(_VALUES)],
    )


def stream_final_metrics(logs: DataFrame) -> DataFrame:
    """Final records of a log stream; they bypass the merge."""
    return final_metrics(logs)


def stream_metric_logs(
    logs: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", pending_days: int | None = None
) -> DataStreamWriter:
    """The writer of both metric logs below ``path`` while records arrive; set a trigger and start it.

    Merged rows go to ``evaluation_metrics``, final records to
    ``final_metrics``, each with the time of writing, readable with
    ``read_metric_log``.  ``checkpoint`` is the folder of the stream's progress
    and its name as a writer: a stream that starts again there goes on behind
    its last whole batch and replaces a batch it had begun, so no row is lost or
    written twice.  Streams with other checkpoints may write to the same path.
    """
    merged = stream_metrics_merge(logs, pending_days).select(F.lit("evaluation_metrics").alias("log"), *MERGED_COLUMNS)
    final = stream_final_metrics(logs).select(F.lit("final_metrics").alias("log"), *FINAL_COLUMNS)
    both = merged.unionByName(final, allowMissingColumns=True)
    return (
        both.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(batch_writer(path, checkpoint, fmt))
    )
