"""Merging sparse training-log records and choosing checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpair.operators.sampling import first_rows
from textpair.sources.metric_logs import FINAL_COLUMNS, MERGED_COLUMNS, TRAIN_KEYS, with_run

# Keys whose presence marks a side as seen, and defaults of the
# checkpoint choice.
TRAIN_MARKS = TRAIN_KEYS
EVAL_MARKS = ["eval_loss", "eval_rouge1"]
KEPT_CHECKPOINTS = 3
BEST_METRIC = "eval_rougeL"


def _any_present(cols: Sequence[str]) -> Column:
    present = F.lit(False)
    for c in cols:
        present = present | F.col(c).isNotNull()
    return present


def final_metrics(logs: DataFrame) -> DataFrame:
    """Records that end a run; they never enter the merge.  Works on streams too."""
    return with_run(logs).where(F.col("train_runtime").isNotNull()).select(*FINAL_COLUMNS)


KEY = ["run", "epoch", "step"]


def with_emissions(logs: DataFrame) -> DataFrame:
    """Number the emissions of each key: adds ``_emits`` and ``_group``.

    A group holds the records of a key after one emission up to and including
    the next.  The state machine is expressed with windows.  A record with
    both sides always emits.  Between such records only the *runs* of equal
    sides matter: the first record of a run emits exactly when something is
    pending before it.  After a run of two or more records something is always
    pending; after a run of one, pending alternates.  So the parity of
    single-record runs since the last long run (or the start) decides.
    """
    train, evaluation = _any_present(TRAIN_MARKS), _any_present(EVAL_MARKS)
    side = (
        F.when(train & evaluation, "both").when(train, "train").when(evaluation, "eval")
    )
    records = with_run(logs).where(F.col("train_runtime").isNull()).select("seq", *MERGED_COLUMNS, side.alias("_side"))
    earlier = (Window.unboundedPreceding, -1)
    by_key = Window.partitionBy(*KEY).orderBy("seq")
    both = (F.col("_side") == "both").eqNullSafe(True)
    segmented = records.withColumn(
        "_segment", F.coalesce(F.sum(both.cast("int")).over(by_key.rowsBetween(*earlier)), F.lit(0))
    )
    segment = [*KEY, "_segment"]
    in_segment = Window.partitionBy(*segment).orderBy("seq")
    single = F.when(F.col("_side").isin("train", "eval"), F.col("_side"))
    previous = F.last(single, ignorenulls=True).over(in_segment.rowsBetween(*earlier))
    marked = segmented.withColumn(
        "_starts", single.isNotNull() & (previous.isNull() | (previous != single))
    )
    runs = marked.withColumn(
        "_run", F.sum(F.col("_starts").cast("int")).over(in_segment.rowsBetween(Window.unboundedPreceding, 0))
    )
    sized = runs.withColumn(
        "_length", F.count(single).over(Window.partitionBy(*segment, "_run"))
    )
    certain = F.when(F.col("_starts") & ((F.col("_run") == 1) | (F.col("_length") >= 2)), F.col("_run"))
    anchored = sized.withColumn("_anchor", F.max(certain).over(in_segment.rowsBetween(*earlier)))
    pending = (F.col("_run") - 1 - F.col("_anchor")) % 2 == 0
    emits = both | (F.col("_starts") & (F.col("_run") > 1) & pending)
    emitting = anchored.withColumn("_emits", F.coalesce(emits, F.lit(False)))
    group = F.coalesce(F.sum(F.col("_emits").cast("int")).over(by_key.rowsBetween(*earlier)), F.lit(0))
    return emitting.withColumn("_group", group).drop("_side", "_segment", "_starts", "_run", "_length", "_anchor")


def merged_groups(flagged: DataFrame) -> DataFrame:
    """One row per emission: the last known value of every column in its group."""
    values = [c for c in MERGED_COLUMNS if c not in KEY]
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in values]
    merged = flagged.groupBy(*KEY, "_group").agg(F.max("_emits").alias("_done"), *latest)
    return merged.where("_done").select(*MERGED_COLUMNS)


def metrics_merge(logs: DataFrame) -> DataFrame:
    """Merge the records of each (run, epoch, step) until both sides are seen.

    Records of a key, ordered by ``seq``, accumulate; a later value replaces an
    earlier one.  When training and evaluation values are both present a row is
    emitted and the key starts afresh, so a key may emit several rows.  NaN is a
    value like any other: a diverged loss is logged as such.
    """
    return merged_groups(with_emissions(logs))


def _usable(merged: DataFrame, metric: str) -> DataFrame:
    return merged.where(F.col(metric).isNotNull() & ~F.isnan(metric))


def best_checkpoint(
    merged: DataFrame, metric: str = BEST_METRIC, greater_is_better: bool = True, run: str | None = None
) -> DataFrame:
    """``(step, epoch, metric)`` of the best checkpoint, per run when a run column is named.

    A tie takes the smallest step.
    """
    row = F.struct("step", "epoch", metric)
    if greater_is_better:
        best = F.max_by(row, F.struct(F.col(metric), -F.col("step")))
    else:
        best = F.min_by(row, F.struct(F.col(metric), F.col("step")))
    per = [run] if run else []
    return _usable(merged, metric).groupBy(*per).agg(best.alias("b")).where("b is not null").select(*per, "b.*")


def retained_checkpoints(
    merged: DataFrame,
    limit: int = KEPT_CHECKPOINTS,
    metric: str = BEST_METRIC,
    greater_is_better: bool = True,
    run: str | None = None,
) -> DataFrame:
    """The ``limit`` best checkpoints, per run when a run column is named."""
    order = [F.desc(metric) if greater_is_better else F.asc(metric), F.col("step")]
    per = [run] if run else []
    return first_rows(_usable(merged, metric), order, limit, per).select(*per, "step", "epoch", metric)
