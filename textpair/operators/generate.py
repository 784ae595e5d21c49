"""Running text generators over a table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Generator = Callable[[list[str]], list[str]]

# Fixed value: rows handed to a generator at once.
BATCH_SIZE = 64
# The model this Python worker has loaded, by its token: one at most.
LOADED: dict[str, Generator] = {}


def short_name(path: str) -> str:
    """Last component of a model path (driver-side twin of ``model_short_name``)."""
    return path.rsplit("/", 1)[-1]


def row_by_model(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every row once per model.

    The models are a literal list, so this is a projection, not a join.
    """
    choices = F.array(
        *[
            F.struct(
                F.lit(i).alias("model_ord"),
                F.lit(path).alias("model_path"),
                F.lit(short_name(path)).alias("model"),
            )
            for i, path in enumerate(models)
        ]
    )
    return df.select("*", F.inline(choices))


def token_of(model) -> str:
    """What tells a model from all others: a hash of what is sent to the tasks.

    Two objects of one class, one object before and after a change, or two
    objects under one path have different tokens.
    """
    return hashlib.sha256(cloudpickle.dumps(model)).hexdigest()


def loaded(token: str, model):
    """The generator itself; one with ``load`` is loaded once per worker process, which then forgets any other."""
    if not hasattr(model, "load"):
        return model
    # ``shared`` is the imported module: functions sent by value have globals of their own.
    import textpair.operators.generate as shared

    if token not in shared.LOADED:
        shared.LOADED.clear()
        shared.LOADED[token] = model.load()
    return shared.LOADED[token]


def _run(generate: Generator, texts: list[str], size: int) -> list[str]:
    out: list[str] = []
    for start in range(0, len(texts), size):
        batch = texts[start : start + size]
        made = list(generate(batch))
        if len(made) != len(batch):
            raise ValueError(f"generator returned {len(made)} texts for {len(batch)} inputs")
        out.extend(made)
    return out


def batch_generate(
    df: DataFrame,
    models: Mapping[str, Generator],
    batch_size: int = BATCH_SIZE,
    input_col: str = "input_text",
    out: str = "generated_output",
) -> DataFrame:
    """One row per (row, model) with the model's output.

    ``models`` maps a model path to a function from a list of texts to a list
    of texts; each text crosses to Python once for all of these, and no other
    column does.  A value with a ``load`` method is loaded in the Python workers
    instead, so weights are never pickled.  Such models take turns: each has
    tasks of its own, and a worker holds one loaded model at most.
    """
    items = list(models.items())
    plain = [i for i, (_, m) in enumerate(items) if not hasattr(m, "load")]
    groups = [*([plain] if plain else []), *([i] for i, (_, m) in enumerate(items) if hasattr(m, "load"))]
    if not groups:
        raise ValueError("no models")
    parts = [_generated(df, [(i, *items[i]) for i in group], batch_size, input_col, out) for group in groups]
    return reduce(DataFrame.unionByName, parts)


def _generated(df: DataFrame, items: list[tuple[int, str, Generator]], batch_size: int, input_col: str, out: str) -> DataFrame:
    """The outputs of some models, with the number each has among all models."""
    tokens = [token_of(m) if hasattr(m, "load") else "" for _, _, m in items]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def outputs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generators = [loaded(token, m) for token, (_, _, m) in zip(tokens, items, strict=True)]
        for series in batches:
            texts = series.tolist()
            columns = [_run(g, texts, batch_size) for g in generators]
            yield pd.Series([list(row) for row in zip(*columns)], dtype="object")

    # Generation is the costly step: never let a plan rewrite run it twice.
    generated = df.withColumn("_outputs", outputs.asNondeterministic()(input_col))
    numbers = F.array(*[F.lit(i) for i, _, _ in items])
    paths = F.array(*[F.lit(path) for _, path, _ in items])
    names = F.array(*[F.lit(short_name(path)) for _, path, _ in items])
    place = F.col("_place")
    exploded = generated.select("*", F.posexplode("_outputs").alias("_place", out)).drop("_outputs")
    kept = [c for c in exploded.columns if c not in ("_place", out, "model_ord", "model_path", "model")]
    return exploded.select(
        *kept, numbers[place].alias("model_ord"), out, paths[place].alias("model_path"), names[place].alias("model")
    )


def align_predictions(
    inputs: DataFrame,
    predictions: DataFrame,
    key: Sequence[str] = ("product_id", "model"),
    column: str = "generated_output",
) -> DataFrame:
    """Attach each input's prediction.

    An input without a prediction, a prediction without an input and two
    predictions for one key are errors.
    """
    key = list(key)
    given = inputs.withColumn("_input", F.lit(True))
    one = predictions.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.max(column).alias("_prediction")
    )
    joined = given.join(one, key, "full")
    checked = (
        F.when(F.col("_input").isNull(), F.raise_error(F.lit("a prediction has no input")))
        .when(F.col("_n").isNull(), F.raise_error(F.lit("an input has no prediction")))
        .when(F.col("_n") > 1, F.raise_error(F.lit("more than one prediction for a key")))
        .otherwise(F.col("_prediction"))
    )
    kept = [c for c in inputs.columns if c != column]
    # The check must survive a reader that drops the column.
    return joined.withColumn(column, checked).where(
        F.col(column).isNotNull() | F.col("_n").isNotNull()
    ).select(*kept, column)
