"""Adding a costly column so that a plan computes it once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_column_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Like ``withColumn``, for a column a later filter must not compute again.

    Catalyst moves a filter on a projected column below the projection and
    evaluates the column's expression in both places, which doubles a Python
    step.  A filter on a generated column stays above its generator, while
    filters on other columns still move below it.
    """
    made = df.withColumn("_made", column)
    return made.withColumn(name, F.explode(F.array("_made"))).drop("_made")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside a lambda would be computed for every element; a
    lambda variable is a computed value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
