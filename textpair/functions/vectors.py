"""Similarity of two vectors or of two texts' term-frequency vectors."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpair.functions.once import with_column_once
from textpair.functions.rouge import rouge_lines
from textpair.functions.text import _col

# Similarities carry six decimals: enough for every report, and it bounds the
# number of distinct values a distribution has to keep.
DECIMALS = 6

_PRODUCT_NAMES = ["dot", "norm_a", "norm_b"]
_PRODUCTS_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in _PRODUCT_NAMES])


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of two dense vectors in double precision; 0 for a zero vector."""
    x = _col(a).cast("array<double>")
    y = _col(b).cast("array<double>")
    norms = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    return F.when(norms > 0, _dot(x, y) / norms).otherwise(F.lit(0.0))


def _term_products(a: str, b: str) -> tuple[int, int, int]:
    x, y = Counter(a.split()), Counter(b.split())
    if len(y) < len(x):
        small, large = y, x
    else:
        small, large = x, y
    dot = sum(n * large[t] for t, n in small.items())
    return dot, sum(n * n for n in x.values()), sum(n * n for n in y.values())


@F.pandas_udf(_PRODUCTS_TYPE)
def _term_products_batch(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    seen: dict[tuple[str, str], tuple[int, int, int]] = {}
    rows = []
    for pair in zip(a, b):
        if pair not in seen:
            seen[pair] = _term_products(*pair)
        rows.append(seen[pair])
    return pd.DataFrame(rows, columns=_PRODUCT_NAMES, dtype="int64")


def text_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of the term-frequency vectors of two texts in one row.

    Both texts are in the row already, so nothing is shuffled; the integer
    products come back from Arrow and the division stays in Spark.
    """
    return _cosine(_term_products_batch(rouge_lines(a), rouge_lines(b)))


def with_text_cosine(df: DataFrame, a: Column | str, b: Column | str, out: str) -> DataFrame:
    """Add ``text_cosine`` as a column that filters may use freely."""
    products = _term_products_batch(rouge_lines(a), rouge_lines(b))
    return with_column_once(df, "_products", products).withColumn(out, _cosine(F.col("_products"))).drop("_products")


def _cosine(t: Column) -> Column:
    norms = F.sqrt(t["norm_a"].cast("double")) * F.sqrt(t["norm_b"].cast("double"))
    cosine = F.when(norms > 0, t["dot"] / norms).otherwise(F.lit(0.0))
    return F.round(cosine, DECIMALS)
