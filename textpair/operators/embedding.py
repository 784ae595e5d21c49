"""Word vectors learned from the corpus, and an embedder of texts made of them.

Words that stand near each other are counted (nearer ones weigh more, in whole
numbers, so sums are exact in any order); the positive pointwise mutual
information of the counts is a symmetric matrix that stays a Spark table.  A
randomised range finder reduces it: a pass over the table multiplies it with a
narrow matrix that every task gets, the products come back as one row per word,
and a small orthogonalisation on the driver makes the next narrow matrix.  What
passes through the driver is vocabulary x dimensions, both parameters, whatever
the corpus; a product above ``MOST_CELLS`` raises.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpair.functions.rouge import rouge_spaced, rouge_tokens
from textpair.operators.sampling import first_rows
from textpair.session import frugal, shared_dir

# Words of the vocabulary, dimensions, and how far neighbours may stand apart.
VOCABULARY = 20_000
DIMENSIONS = 128
REACH = 5
# Further columns of the range finder, its passes over the matrix, its seed.
OVERSAMPLING = 16
PASSES = 3
SEED = 42
# Cells of the narrow matrix (200 MB) that the driver and every task may hold.
MOST_CELLS = 25_000_000
# Weight of a word in a text: SMOOTHING / (SMOOTHING + its share of all words).
SMOOTHING = 1e-3
# Pairs a task counts before it hands them on, and tokens it looks at together.
HELD_PAIRS = 1 << 20
HELD_TOKENS = 1 << 18
# A vocabulary with at most so many pairs is counted in a square of numbers (32 MB), a larger one by sorting.
MOST_SQUARE = 1 << 22

UNKNOWN = -1


def _token_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``_tokens``: one row per text."""
    return df.select(F.explode(F.array(*[rouge_tokens(c) for c in cols])).alias("_tokens"))


def _stored_token_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same, cut into tokens once: written to the shared folder as text with single spaces."""
    path = shared_dir(df.sparkSession, "tokens")
    df.select(F.explode(F.array(*[rouge_spaced(c) for c in cols])).alias("_line")).write.parquet(path)
    return df.sparkSession.read.parquet(path).select(F.array_remove(F.split("_line", " "), "").alias("_tokens"))


def word_counts(df: DataFrame, cols: Sequence[str], size: int = VOCABULARY) -> DataFrame:
    """``(token, n)`` of the most frequent words; ties by code point."""
    return _counted(_token_rows(df, cols), size)


def _counted(texts: DataFrame, size: int) -> DataFrame:
    counts = texts.select(F.explode("_tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return first_rows(counts, [F.desc("n"), F.col("token")], size)


def weights(reach: int) -> list[int]:
    """Whole weights in proportion to 1 / distance."""
    multiple = int(np.lcm.reduce(np.arange(1, reach + 1)))
    return [multiple // d for d in range(1, reach + 1)]


def cooccurrences(df: DataFrame, cols: Sequence[str], entries: Broadcast, reach: int = REACH) -> DataFrame:
    """``(a, b, w)`` with a <= b: how much two words of the vocabulary (by number) stand near each other.

    Other words keep their places; texts of different columns do not meet.
    """
    return _paired(_token_rows(df, cols), entries, reach)


def _paired(texts: DataFrame, entries: Broadcast, reach: int) -> DataFrame:
    # One Python step looks words up and counts pairs: a task has one worker and ids never return to the JVM.
    pairs = texts.mapInArrow(frugal(_count_pairs(entries, weights(reach))), "a int, b int, w long")
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("w"))


def stored_cooccurrences(df: DataFrame, cols: Sequence[str], entries: Broadcast, reach: int = REACH) -> DataFrame:
    """The same, written to the shared folder: ``information`` reads it several times, the texts are read once."""
    return _stored_pairs(cooccurrences(df, cols, entries, reach))


def _stored_pairs(pairs: DataFrame) -> DataFrame:
    path = shared_dir(pairs.sparkSession, "pairs")
    pairs.write.parquet(path)
    return pairs.sparkSession.read.parquet(path)


def _parts(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """A batch of token arrays in slices of about ``HELD_TOKENS`` tokens, at least one text each."""
    ends, start = lists.offsets.to_numpy()[1:], 0
    while start < len(lists):
        first = lists.offsets[start].as_py()
        stop = max(start + 1, int(np.searchsorted(ends, first + HELD_TOKENS, side="right")))
        yield lists.slice(start, stop - start)
        start = stop


def _near_pairs(lists: pa.ListArray, words: pa.Array, numbers: pa.Array, near: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``(low, high, weight)`` of the known words that stand at each distance in the same text."""
    found = numbers.take(pc.index_in(lists.flatten(), value_set=words))
    flat = pc.fill_null(found, UNKNOWN).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    text = np.repeat(np.arange(len(sizes)), sizes)
    for distance, weight in enumerate(near, 1):
        x, y = flat[:-distance], flat[distance:]
        both = (x >= 0) & (y >= 0) & (text[:-distance] == text[distance:])
        yield np.minimum(x[both], y[both]), np.maximum(x[both], y[both]), weight


def _pair_batch(low: np.ndarray, high: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(sums)], names=["a", "b", "w"]
    )


def _count_pairs(entries: Broadcast, near: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers = entries.value
        parts = (part for batch in batches for part in _parts(batch.column("_tokens")))
        found = (pairs for part in parts for pairs in _near_pairs(part, words, numbers, near))
        yield from _in_square(found, len(words)) if len(words) ** 2 <= MOST_SQUARE else _by_sorting(found)

    return run


def _in_square(found: Iterator[tuple[np.ndarray, np.ndarray, int]], size: int) -> Iterator[pa.RecordBatch]:
    square = np.zeros(size * size, np.int64)
    for low, high, weight in found:
        np.add.at(square, low * size + high, weight)
    places = np.flatnonzero(square)
    for start in range(0, len(places), HELD_TOKENS):
        part = places[start : start + HELD_TOKENS]
        yield _pair_batch(part // size, part % size, square[part])


def _by_sorting(found: Iterator[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    keys, values, held = [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        if keys:
            pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, place, np.concatenate(values))
            yield _pair_batch(pairs >> 32, pairs & 0xFFFFFFFF, sums)
        keys.clear()
        values.clear()

    for low, high, weight in found:
        pairs, n = np.unique(low << 32 | high, return_counts=True)
        keys.append(pairs)
        values.append(n.astype(np.int64) * weight)
        held += len(pairs)
        if held > HELD_PAIRS:
            yield from out()
            held = 0
    yield from out()


def information(pairs: DataFrame) -> DataFrame:
    """``(a, b, v)``: positive pointwise mutual information, both triangles of the matrix, rows by ``a``.

    Sums per word are small tables, so the joins need no hot keys: every word has at most one row per other word.
    """
    both = pairs.select("a", "b", "w").unionByName(
        pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    )
    sums = both.groupBy("a").agg(F.sum("w").alias("s"))
    total = sums.agg(F.sum("s").alias("t"))
    joined = both.join(sums.withColumnRenamed("s", "_sa"), "a").join(
        sums.select(F.col("a").alias("b"), F.col("s").alias("_sb")), "b"
    ).crossJoin(F.broadcast(total))
    v = F.ln(F.col("w").cast("double") * F.col("t") / (F.col("_sa").cast("double") * F.col("_sb")))
    return joined.select("a", "b", v.alias("v")).where("v > 0")


def times(matrix: DataFrame, narrow: np.ndarray) -> np.ndarray:
    """The matrix, a table ``(a, b, v)``, times a narrow one: a row per word comes back.

    A task that holds a whole row returns one product, so rows are kept together by ``a``; parts of a row are added here.
    """
    spark = matrix.sparkSession
    sent = spark.sparkContext.broadcast(narrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = sent.value
        for batch in batches:
            a, b, v = (batch.column(c).to_numpy() for c in ("a", "b", "v"))
            starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(a))
            rows = np.empty((len(starts), factor.shape[1]))
            for i, (start, end) in enumerate(zip(starts, ends, strict=True)):
                rows[i] = v[start:end] @ factor[b[start:end]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[starts]), pa.array(b[starts]), pa.array(list(rows), pa.list_(pa.float64()))], names=["a", "b", "y"]
            )

    # Few rows per word: one for each Arrow batch that holds some of it.
    parts = matrix.mapInArrow(frugal(run), "a int, b int, y array<double>").toArrow()
    order = np.lexsort((parts["b"].to_numpy(), parts["a"].to_numpy()))
    product = np.zeros_like(narrow)
    values = parts["y"].combine_chunks().flatten().to_numpy().reshape(-1, narrow.shape[1])
    np.add.at(product, parts["a"].to_numpy()[order], values[order])
    sent.destroy()
    return product


def eigenvectors(matrix: DataFrame, n: int, dimensions: int, seed: int = SEED) -> np.ndarray:
    """Word vectors: the strongest eigenvectors of a symmetric matrix, scaled by the roots of their strengths."""
    width = min(n, dimensions + OVERSAMPLING)
    if n * width > MOST_CELLS:
        raise ValueError(f"{n} words in {width} dimensions are more than {MOST_CELLS} cells")
    basis = np.random.default_rng(seed).standard_normal((n, width))
    for _ in range(PASSES):
        basis, _ = np.linalg.qr(times(matrix, basis))
    values, vectors = np.linalg.eigh(basis.T @ times(matrix, basis))
    strongest = np.argsort(-np.abs(values), kind="stable")[: min(dimensions, width)]
    found = basis @ vectors[:, strongest] * np.sqrt(np.abs(values[strongest]))
    # The sign of an eigenvector is free: its largest entry is positive.
    found *= np.where(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])] < 0, -1.0, 1.0)
    return np.pad(found, ((0, 0), (0, dimensions - found.shape[1])))


def embedded(words: dict[str, int], matrix: np.ndarray) -> Callable[[list[str]], np.ndarray]:
    """A function from texts to the sums of their words' rows; a text without known words is all zeros."""
    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), matrix.shape[1]))
        for i, text in enumerate(texts):
            tokens = re.sub("[^a-z0-9]+", " ", text.lower()).split()
            known = [words[t] for t in tokens if t in words]
            if known:
                places, n = np.unique(known, return_counts=True)
                out[i] = n @ matrix[places] / len(tokens)
        return out

    return run


class LearnedEmbedder:
    """An embedder for ``text_vectors`` and ``semantic_similarity``; its words and vectors are sent to a worker once."""

    def __init__(self, sent: Broadcast) -> None:
        self.sent = sent

    def load(self) -> Callable[[list[str]], np.ndarray]:
        return embedded(*self.sent.value)


def learn_embedder(
    df: DataFrame, cols: Sequence[str], size: int = VOCABULARY, dimensions: int = DIMENSIONS, reach: int = REACH, seed: int = SEED
) -> LearnedEmbedder:
    """Learn word vectors from text columns.

    Texts are then weighted means of their words' vectors (frequent words weigh
    less), so two texts without a common word can be alike.
    """
    spark = df.sparkSession
    texts = _stored_token_rows(df, cols)
    counted = _counted(texts, size).collect()
    tokens, n = [r["token"] for r in counted], np.array([r["n"] for r in counted], float)
    words = {t: i for i, t in enumerate(tokens)}
    entries = spark.sparkContext.broadcast((pa.array(tokens, pa.string()), pa.array(np.arange(len(tokens), dtype=np.int32))))
    path = shared_dir(spark, "information")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    information(_stored_pairs(_paired(texts, entries, reach))).repartition(tasks, "a").sortWithinPartitions("a", "b").write.parquet(path)
    matrix = spark.read.parquet(path)
    vectors = eigenvectors(matrix, len(tokens), dimensions, seed) if tokens else np.zeros((0, dimensions))
    share = n / max(1.0, n.sum())
    weighted = (vectors * (SMOOTHING / (SMOOTHING + share))[:, None]).astype(np.float32)
    return LearnedEmbedder(spark.sparkContext.broadcast((words, weighted)))
