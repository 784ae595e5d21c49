"""Text vectors and the similarity of targets with outputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpair.functions.once import bound
from textpair.functions.rouge import rouge_tokens
from textpair.functions.text import as_text
from textpair.functions.vectors import DECIMALS, cosine_similarity, with_text_cosine
from textpair.operators.generate import loaded, token_of
from textpair.session import frugal

Embedder = Callable[[list[str]], np.ndarray]

# Texts handed to an embedder at once.
EMBED_BATCH = 256


def _term_counts(tokens: Column) -> Column:
    """``array<struct<token, tf>>``: the tokens sorted, then one entry per run of equal ones."""
    def runs(words: Column) -> Column:
        starts = F.filter(
            F.transform(words, lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), i)), lambda i: i.isNotNull()
        )
        return bound(starts, lambda begins: F.transform(begins, lambda i, k: F.struct(
            F.get(words, i).alias("token"), (F.coalesce(F.get(begins, k + 1), F.size(words)) - i).cast("long").alias("tf")
        )))

    return bound(F.sort_array(tokens), runs)


def _vectors(texts: DataFrame, embedder, batch_size: int) -> DataFrame:
    """``(_text, vector)``: each distinct text of the table embedded once, ``batch_size`` at a time.

    An embedder with ``load`` is loaded once per Python worker; another one takes its place there.
    """
    token = token_of(embedder) if hasattr(embedder, "load") else ""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = loaded(token, embedder)
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.column("_text").slice(start, batch_size)
                made = np.asarray(run(part.to_pylist()), dtype="float32")
                if len(made) != len(part):
                    raise ValueError(f"embedder returned {len(made)} vectors for {len(part)} texts")
                offsets = np.arange(len(made) + 1, dtype=np.int32) * (made.size // len(made))
                vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part, vectors], names=["_text", "vector"])

    return texts.distinct().mapInArrow(frugal(embed), "_text string, vector array<float>")


def text_vectors(
    df: DataFrame, column: str, key: str = "product_id", embedder: Embedder | None = None, batch_size: int = EMBED_BATCH
) -> DataFrame:
    """Vectors of a text column.

    With an ``embedder`` (a function from texts to a matrix, or an object whose
    ``load`` returns one): ``(key, vector)``, each distinct text of the table
    embedded once.  Without: sparse term frequencies ``(key, token, tf)``,
    counted where the text is.
    """
    if embedder is None:
        return df.select(key, F.inline(_term_counts(rouge_tokens(column))))
    texts = df.select(key, F.coalesce(F.col(column), F.lit("")).alias("_text"))
    return texts.join(_vectors(texts.select("_text"), embedder, batch_size), "_text").select(key, "vector")


def semantic_similarity(
    results: DataFrame,
    model: str | None = None,
    embedder: Embedder | None = None,
    target: str = "target_query",
    output: str = "generated_output",
    out: str = "semantic_similarity",
    batch_size: int = EMBED_BATCH,
) -> DataFrame:
    """Add the cosine of target and output, after keeping one model if named.

    With an ``embedder`` each distinct text of the table is embedded once and
    joined to its rows; a text that fills a third of the table is a hot key that
    the adaptive skew join splits.
    """
    rows = results if model is None else results.where(F.col("model") == model)
    if embedder is None:
        return with_text_cosine(rows, as_text(target), as_text(output), out)
    keyed = rows.withColumns({"_target": as_text(target), "_output": as_text(output)})
    texts = keyed.select(F.explode(F.array("_target", "_output")).alias("_text"))
    vectors = _vectors(texts, embedder, batch_size)
    paired = keyed.join(vectors.select(F.col("_text").alias("_target"), F.col("vector").alias("_a")), "_target").join(
        vectors.select(F.col("_text").alias("_output"), F.col("vector").alias("_b")), "_output"
    )
    similarity = F.coalesce(cosine_similarity("_a", "_b"), F.lit(0.0))
    return paired.withColumn(out, F.round(similarity, DECIMALS)).select(*rows.columns, out)
