"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpair.session import frugal, give_back, shared_dir, small_batches  # noqa: F401

# What a Python worker keeps from one task to the next: one owner's state at most.
RESIDENT: dict[str, object] = {}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage.

    Losing an executor later costs a reread of these files, nothing more.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resident(owner: str, build: Callable):
    """``build()``, kept by the worker until another owner needs the memory."""
    # ``shared`` is the imported module: functions sent by value have globals of their own.
    import textpair.llm.common as shared

    if owner not in shared.RESIDENT:
        shared.RESIDENT.clear()
        shared.RESIDENT[owner] = build()
    return shared.RESIDENT[owner]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda variable is bound to a computed value, so an expression that is
    used inside another lambda is not evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_key(value: Column) -> Column:
    """A string as a join key that is never null: null is '', others start with '='."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value))


def running_total(df: DataFrame, group: str, order_hash: str, value: str, ties: list[str], out: str,
                  slot_sums: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the same ``group``.

    Rows are ordered by the 64-bit hash column ``order_hash``, then ``ties``.  A
    group of any size is cut into 4,096 hash slots: the sums per slot are
    computed first (partial sums before the shuffle) and give every slot its
    base, then each slot is summed on its own.  A group that holds a third of
    the table is so spread over 4,096 tasks.  ``group`` must not be null.
    """
    slotted = df.withColumn("_slot", F.shiftright(order_hash, 52))
    if slot_sums is None:
        slot_sums = slot_totals(df, group, order_hash, value)
    before = Window.partitionBy(group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slot_sums.select(group, "_slot", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = (
        Window.partitionBy(group, "_slot").orderBy(order_hash, *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        slotted.join(bases, [group, "_slot"])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_slot", "_base")
    )


def slot_totals(df: DataFrame, group: str, order_hash: str, value: str) -> DataFrame:
    """``group, _slot, _total`` for ``running_total``."""
    return df.groupBy(group, F.shiftright(order_hash, 52).alias("_slot")).agg(F.sum(value).alias("_total"))
