import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textpair.operators import checkpoints
from textpair.session import shared_dir
from textpair.sources.metric_logs import (
    EVAL_KEYS, FINAL_COLUMNS, LOG_SCHEMA, MERGED_COLUMNS, TRAIN_KEYS, batch_writer, read_metric_log,
)
from textpair.streaming.evaluate import append_available
from textpair.streaming.metrics import stream_final_metrics, stream_metric_logs, stream_metrics_merge

START = datetime.datetime(2024, 1, 1)


def record(seq, step, epoch=1.0, **values):
    row = dict.fromkeys(LOG_SCHEMA.names)
    row.update(seq=seq, ts=START + datetime.timedelta(seconds=seq), epoch=epoch, step=step, **values)
    return row


def frame(spark, records):
    return spark.createDataFrame([tuple(r[c] for c in LOG_SCHEMA.names) for r in records], LOG_SCHEMA)


def merged_by_hand(records):
    """The definition: accumulate per key, emit and forget when both sides are there."""
    pending, out = {}, []
    for r in sorted(records, key=lambda r: r["seq"]):
        if r["train_runtime"] is not None:
            continue
        key = (r["run"], r["epoch"], r["step"])
        entry = pending.setdefault(key, {})
        entry.update({c: r[c] for c in [*TRAIN_KEYS, *EVAL_KEYS] if r[c] is not None})
        if any(c in entry for c in TRAIN_KEYS) and ("eval_loss" in entry or "eval_rouge1" in entry):
            out.append(tuple([*key, *[entry.get(c) for c in MERGED_COLUMNS[3:]]]))
            del pending[key]
    return Counter(out)


def rows(df):
    return Counter(tuple(r[c] for c in MERGED_COLUMNS) for r in df.collect())


def random_records(seed, n=600, steps=12):
    rnd, out = random.Random(seed), []
    for seq in range(n):
        step = rnd.choice([0] * steps + list(range(steps)))  # key 0 holds half of all records
        kind = rnd.choice(["train", "train", "eval", "eval", "both", "neither", "final"])
        values = {}
        if kind in ("train", "both"):
            values[rnd.choice(TRAIN_KEYS)] = float(seq)
        if kind in ("eval", "both"):
            values[rnd.choice(["eval_loss", "eval_rouge1"])] = float(seq)
        if kind == "neither":
            values["eval_runtime"] = float(seq)
        if kind == "final":
            values["train_runtime"] = float(seq)
        out.append(record(seq, step, run=rnd.choice(["a", "b", None]), **values))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merge_matches_the_state_machine(spark, seed):
    records = random_records(seed)
    expected = merged_by_hand(records)
    assert rows(checkpoints.metrics_merge(frame(spark, records).repartition(5))) == expected
    assert sum(expected.values()) > 50


def test_train_train_eval_and_train_eval_train(spark):
    first = [record(0, 1, loss=1.0), record(1, 1, loss=2.0), record(2, 1, eval_loss=3.0)]
    second = [record(3, 2, loss=1.0), record(4, 2, eval_loss=2.0), record(5, 2, loss=9.0)]
    df = frame(spark, first + second)
    got = {(r["step"], r["loss"], r["eval_loss"]) for r in checkpoints.metrics_merge(df).collect()}
    assert got == {(1, 2.0, 3.0), (2, 1.0, 2.0)}


def arriving(spark, records, name, batches):
    """A file stream whose batches arrive one after the other."""
    path = shared_dir(spark, name)
    size = -(-len(records) // batches)
    for start in range(0, len(records), size):
        frame(spark, records[start : start + size]).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def streamed(spark, records, batches, **options):
    out = shared_dir(spark, "merged")
    append_available(stream_metrics_merge(arriving(spark, records, "logs", batches), **options), out, shared_dir(spark, "cp"))
    return spark.read.parquet(out)


def test_stream_equals_the_batch_merge(spark):
    records = random_records(9, 90, 4)
    assert rows(streamed(spark, records, 3)) == merged_by_hand(records)


def days_apart(days):
    late, other = record(2, 1, eval_loss=1.0), record(1, 2, loss=5.0)
    late["ts"] = START + datetime.timedelta(days=days)
    other["ts"] = START + datetime.timedelta(days=days - 1)
    return [record(0, 1, loss=1.0), other, late]


def test_a_pair_30_days_apart_is_merged(spark):
    assert [(r["step"], r["loss"], r["eval_loss"]) for r in streamed(spark, days_apart(30), 3).collect()] == [(1, 1.0, 1.0)]


def test_old_records_are_forgotten_on_demand(spark):
    assert streamed(spark, days_apart(30), 3, pending_days=7).count() == 0


def test_nan_is_a_value_in_batch_and_stream(spark):
    records = [record(0, 1, loss=float("nan")), record(1, 1, eval_loss=0.5), record(2, 2, grad_norm=1.0), record(3, 2, eval_loss=float("nan"))]
    def shown(df):
        return sorted((r["step"], str(r["loss"]), str(r["grad_norm"]), str(r["eval_loss"])) for r in df.collect())

    want = [(1, "nan", "None", "0.5"), (2, "None", "1.0", "nan")]
    assert shown(checkpoints.metrics_merge(frame(spark, records))) == shown(streamed(spark, records, 2)) == want


def test_runs_stay_apart(spark):
    records = [record(0, 1, run="a", loss=1.0), record(1, 1, run="b", eval_loss=2.0)]
    assert checkpoints.metrics_merge(frame(spark, records)).count() == 0
    without = frame(spark, [record(0, 1, loss=1.0), record(1, 1, eval_loss=2.0)]).drop("run")
    assert checkpoints.metrics_merge(without).first()["run"] is None


def test_final_stream(spark):
    records = random_records(3, 60)
    out = shared_dir(spark, "final")
    append_available(stream_final_metrics(arriving(spark, records, "logs", 2)), out, shared_dir(spark, "cp"))
    got = sorted(r["train_runtime"] for r in spark.read.parquet(out).collect())
    assert got == sorted(r["train_runtime"] for r in records if r["train_runtime"] is not None)


def test_best_and_retained(spark):
    scores = [(100, 1.0, 70.0), (200, 2.0, 75.0), (300, 3.0, 75.0), (400, 4.0, 60.0), (500, 5.0, None), (600, 6.0, float("nan"))]
    df = spark.createDataFrame(scores, "step long, epoch double, eval_rougeL double")
    assert tuple(checkpoints.best_checkpoint(df).first()) == (200, 2.0, 75.0)
    assert tuple(checkpoints.best_checkpoint(df, greater_is_better=False).first()) == (400, 4.0, 60.0)
    assert [r["step"] for r in checkpoints.retained_checkpoints(df).collect()] == [200, 300, 100]
    runs = df.withColumn("run", F.lit("a")).unionByName(df.withColumn("run", F.lit("b")))
    kept = checkpoints.retained_checkpoints(runs, 2, run="run").collect()
    assert sorted((r["run"], r["step"]) for r in kept) == [("a", 200), ("a", 300), ("b", 200), ("b", 300)]
    best = checkpoints.best_checkpoint(runs, run="run").collect()
    assert sorted((r["run"], r["step"]) for r in best) == [("a", 200), ("b", 200)]


def run_available(stream, path, checkpoint, fmt="parquet"):
    stream_metric_logs(stream, path, checkpoint, fmt).trigger(availableNow=True).start().awaitTermination()


def both_logs(spark, path, fmt="parquet"):
    merged = read_metric_log(spark, path, "evaluation_metrics", fmt)
    final = read_metric_log(spark, path, "final_metrics", fmt)
    assert merged.columns == ["timestamp", *MERGED_COLUMNS] and final.columns == ["timestamp", *FINAL_COLUMNS]
    assert merged.where("timestamp IS NULL").count() == final.where("timestamp IS NULL").count() == 0
    return rows(merged), sorted(r["train_runtime"] for r in final.collect())


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_streamed_logs_equal_the_batch_logs(spark, fmt):
    records = random_records(4, 80, 4)
    path, state = shared_dir(spark, "logs"), shared_dir(spark, "cp")
    run_available(arriving(spark, records, "records", 3), path, state, fmt)
    merged, final = both_logs(spark, path, fmt)
    assert merged == merged_by_hand(records)
    assert final == sorted(r["train_runtime"] for r in checkpoints.final_metrics(frame(spark, records)).collect())


def test_streamed_logs_go_on_after_a_restart(spark):
    """Pending sides wait in the state between two runs, and old batches are not written again."""
    path, state, source = (shared_dir(spark, name) for name in ("logs", "cp", "records"))
    first = [record(0, 1, loss=1.0), record(1, 2, loss=2.0), record(2, 2, eval_loss=3.0)]
    for records in (first, [record(3, 1, eval_loss=4.0)], []):
        if records:
            frame(spark, records).coalesce(1).write.mode("append").parquet(source)
        run_available(spark.readStream.schema(LOG_SCHEMA).parquet(source), path, state)
    assert both_logs(spark, path)[0] == merged_by_hand([*first, record(3, 1, eval_loss=4.0)])


def test_a_replayed_batch_adds_no_row(spark):
    path = shared_dir(spark, "logs")
    merged = checkpoints.metrics_merge(frame(spark, [record(0, 1, loss=1.0), record(1, 1, eval_loss=2.0)]))
    batch = merged.selectExpr("'evaluation_metrics' AS log", "*", *[f"cast(NULL AS double) AS {c}" for c in FINAL_COLUMNS if c not in merged.columns])
    write = batch_writer(path, "a")
    for number in (0, 1, 1, 0):
        write(batch, number)
    assert read_metric_log(spark, path, "evaluation_metrics").count() == 2
    batch_writer(path, "b")(batch, 0)
    assert read_metric_log(spark, path, "evaluation_metrics").count() == 3
    assert read_metric_log(spark, path, "final_metrics").count() == 0
    with pytest.raises(ValueError):
        batch_writer(path, "a", "xml")


@pytest.mark.parametrize("seed", [9, 10])
def test_state_by_key_equals_the_batch_merge(spark, seed):
    records = random_records(seed, 90, 4)
    assert rows(streamed(spark, records, 3, per_key=True)) == merged_by_hand(records)


def test_nan_stays_a_value_in_state_by_key(spark):
    records = [record(0, 1, loss=float("nan")), record(1, 1, eval_loss=0.5), record(2, 2, grad_norm=1.0)]
    (got,) = streamed(spark, records, 2, per_key=True).collect()
    assert str(got["loss"]) == "nan" and got["grad_norm"] is None and got["eval_loss"] == 0.5


def state_rows(spark, records, batches, **options):
    """Rows of the merge's state after each batch."""
    merged = stream_metrics_merge(arriving(spark, records, "logs", batches), **options)
    query = merged.writeStream.outputMode("append").format("noop").option("checkpointLocation", shared_dir(spark, "cp"))
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    return [sum(o["numRowsTotal"] for o in progress["stateOperators"]) for progress in query.recentProgress]


def test_state_by_key_ends_empty_when_keys_emit(spark):
    opened = [record(i, i, loss=1.0) for i in range(6)]
    closed = [record(6 + i, i, eval_loss=1.0) for i in range(6)]
    counts = state_rows(spark, opened + closed, 2, per_key=True)
    assert counts[0] == 6 and counts[-1] == 0


@pytest.mark.parametrize(("days", "merged"), [(7, 0), (None, 1)])
def test_state_by_key_forgets_on_demand(spark, days, merged):
    assert streamed(spark, days_apart(30), 3, per_key=True, pending_days=days).count() == merged
