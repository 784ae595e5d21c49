"""Quality scores from random-indexing word vectors and a small network.

Random indexing gives every token a sparse random index vector; a token's word
vector is the sum of the index vectors of its neighbours in the training texts.
A document is the mean and the spread of its tokens' vectors, its length and
the share of tokens that repeat the one before.  A network of two layers in
numpy turns this into a score; its temperature is set on rows that the weights
were not fitted to, so scores are probabilities.

The classifier is fitted on at most about ``SAMPLE`` labelled rows, drawn by
hash.  Token counts and vectors of the sample are summed in Spark; the driver
gets ``VOCABULARY`` vectors and one pooled vector per sampled row.  Tokens
outside the vocabulary count as their shape (capitals, letters, digits, other).

Scoring reads whole texts in blocks of bounded size.

Edge cases: a null or empty text has the features of no tokens and gets a
score like any other; ids with contradicting labels and null labels are not
learned from; without any label every score is 0.5; rows without an id are
scored but not learned from and not held out; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpair.llm.common import frugal, stored
from textpair.llm.language_id import held_out
from textpair.session import ship_package

SAMPLE = 12_000
VOCABULARY = 20_000
# Rarer tokens of the sample count as their shape there too, as they do in other texts.
LEAST_COUNT = 20
DIMENSIONS = 64
NONZERO = 8
REACH = 2
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.3
# Standard deviations beyond which a feature no longer counts.
FARTHEST = 4.0
REMEMBERED_TOKENS = 300_000
BLOCK_CHARS = 200_000

TOKEN = re.compile(r"\w+|[^\w\s]+")
SHAPES = ["<AA>", "<Aa>", "<aa>", "<00>", "<..>"]


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text) if text else []


def shape(token: str) -> str:
    if token.isalpha():
        return "<AA>" if len(token) > 1 and token.isupper() else "<Aa>" if token[0].isupper() else "<aa>"
    return "<00>" if token.isdigit() else "<..>"


def index_vector(token: str) -> np.ndarray:
    """Sparse, ternary and a function of the token alone."""
    random = np.random.Generator(np.random.PCG64(xxhash.xxh3_64_intdigest(token)))
    vector = np.zeros(DIMENSIONS, np.float32)
    places = random.choice(DIMENSIONS, NONZERO, replace=False)
    vector[places] = random.choice(np.array([-1.0, 1.0], np.float32), NONZERO)
    return vector


class TokenNumbers(dict):
    """Numbers of tokens; those outside the vocabulary have that of their shape."""

    def __init__(self, vocabulary: list[str]):
        super().__init__((token, i) for i, token in enumerate(vocabulary))
        self.base = len(self)

    def __missing__(self, token: str) -> int:
        number = self[shape(token)]
        if len(self) < self.base + REMEMBERED_TOKENS:
            self[token] = number
        return number

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


@dataclass
class QualityModel:
    vocabulary: list[str]
    vectors: np.ndarray
    center: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float


def blocks(text: str) -> Iterator[str]:
    """A long text in blocks that end between tokens; together the whole text."""
    start = 0
    while start < len(text):
        end = min(start + BLOCK_CHARS, len(text))
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[start:end]
        start = end


def pooled(text: str | None, numbers: TokenNumbers, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the tokens' vectors, log length, share of repeats."""
    total, squares = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    n, repeats, last = 0, 0, -1
    for block in blocks(text or ""):
        tokens = tokens_of(block)
        if not tokens:
            continue
        own = vectors[numbers.of(tokens)]
        total += own.sum(axis=0)
        squares += np.einsum("nd,nd->d", own, own)
        repeats += sum(a == b for a, b in zip(tokens, tokens[1:])) + (tokens[0] == last)
        n, last = n + len(tokens), tokens[-1]
    count = max(n, 1)
    mean = total / count
    spread = np.sqrt(np.maximum(squares / count - mean * mean, 0))
    return np.concatenate([mean, spread, [np.log1p(n), repeats / count]]).astype(np.float32)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column("text").to_pylist():
            counts.update(tokens_of(text))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"]
        )


def context_batches(vocabulary: list[str]):
    """Sums of the neighbours' index vectors per token of the vocabulary, one row per token and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = TokenNumbers(vocabulary)
        index = np.stack([index_vector(t) for t in vocabulary])
        sums = np.zeros((len(vocabulary), DIMENSIONS), np.float64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for block in blocks(text or ""):
                    own = numbers.of(tokens_of(block))
                    around = np.zeros((len(own), DIMENSIONS), np.float32)
                    for step in range(1, min(REACH, len(own) - 1) + 1):
                        around[step:] += index[own[:-step]]
                        around[:-step] += index[own[step:]]
                    np.add.at(sums, own, around)
        used = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(list(sums[used].astype(np.float32)), pa.list_(pa.float32()))],
            names=["token", "vector"],
        )

    return run


def add_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for token, vector in zip(batch.column("token").to_pylist(), vectors, strict=True):
            sums[token] = sums.get(token, 0) + vector
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float32()))], names=["token", "vector"]
    )


def pool_batches(vocabulary: list[str], vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = TokenNumbers(vocabulary)
        for batch in batches:
            rows = [pooled(t, numbers, vectors) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.float32()))],
                names=["doc_id", "label", "features"],
            )

    return run


def logits(features: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.maximum(features @ w1 + b1, 0) @ w2 + b2[0]


def scaled(features: np.ndarray, center: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised features.  They are bounded, so a text far longer or shorter than any
    learned from is judged like the longest or shortest of those."""
    return np.clip((features - center) / spread, -FARTHEST, FARTHEST)


def fit_network(features: np.ndarray, labels: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Two layers by Adam on the log loss, in batches."""
    random = np.random.default_rng(seed)
    width = features.shape[1]
    layers = [
        random.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN),
        random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1),
    ]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in layers]
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(labels))
        for rows in np.array_split(order, max(1, len(labels) // 128)):
            x, y = features[rows], labels[rows]
            hidden = x @ layers[0] + layers[1]
            active = np.maximum(hidden, 0)
            error = (1 / (1 + np.exp(-np.clip(active @ layers[2] + layers[3][0], -40, 40))) - y) / len(rows)
            back = np.outer(error, layers[2]) * (hidden > 0)
            slopes = [x.T @ back + 1e-4 * layers[0], back.sum(axis=0), active.T @ error + 1e-4 * layers[2], error.sum(keepdims=True)]
            step += 1
            for i, slope in enumerate(slopes):
                first, second = moments[i]
                first += 0.1 * (slope - first)
                second += 0.001 * (slope * slope - second)
                layers[i] = layers[i] - 0.003 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return layers


def fit_temperature(values: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss on rows kept from the fit."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        z = np.where(labels == 1, values, -values) / t
        return float(np.logaddexp(0, -z).mean())

    return float(min(np.geomspace(0.25, 8, 61), key=loss))


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> QualityModel | None:
    """Fit on labelled rows: ``docs(doc_id, text)`` and ``labels(doc_id, label)``; None without labels."""
    ship_package(docs.sparkSession)
    agreed = (
        labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").drop("high")
    )
    parts = 1_000_000
    known = agreed.count()
    chosen = agreed.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < -(-most * parts // max(known, most)))
    # At most about ``most`` narrow rows: small enough to broadcast.
    sample = stored(
        docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", F.col("label").cast("int").alias("label"))), "doc_id")
        .repartition(docs.sparkSession.sparkContext.defaultParallelism),
        "quality-sample",
    )
    if sample.isEmpty():
        return None
    texts = sample.select("text")
    counted = texts.mapInArrow(frugal(count_batches), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequent = counted.where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "token").limit(VOCABULARY)
    vocabulary = [*SHAPES, *(r["token"] for r in frequent.collect())]

    sums = texts.mapInArrow(frugal(context_batches(vocabulary)), "token int, vector array<float>")
    vectors = np.zeros((len(vocabulary), DIMENSIONS), np.float32)
    for r in sums.repartition("token").mapInArrow(add_batches, "token int, vector array<float>").toLocalIterator():
        vectors[r["token"]] = r["vector"]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)

    rows = sample.select("doc_id", "label", "text").mapInArrow(
        pool_batches(vocabulary, vectors), "doc_id long, label int, features array<float>"
    ).orderBy("doc_id").collect()
    features = np.array([r["features"] for r in rows], np.float64)
    y = np.array([r["label"] for r in rows], np.float64)
    kept = np.array([xxhash.xxh3_64_intdigest(str(r["doc_id"])) % 5 == 0 for r in rows])
    if kept.all():
        kept[:] = False
    center, spread = features[~kept].mean(axis=0), features[~kept].std(axis=0) + 1e-3
    inputs = scaled(features, center, spread)
    layers = fit_network(inputs[~kept], y[~kept])
    temperature = fit_temperature(logits(inputs[kept], layers), y[kept])
    return QualityModel(vocabulary, vectors, center, spread, layers, temperature)


def scores_of(texts: list[str | None], numbers: TokenNumbers, model: QualityModel) -> np.ndarray:
    rows = [pooled(t, numbers, model.vectors) for t in texts]
    features = np.array(rows, np.float64).reshape(len(rows), len(model.center))
    values = logits(scaled(features, model.center, model.spread), model.layers) / model.temperature
    return 1 / (1 + np.exp(-np.clip(values, -40, 40)))


def score_batches(model: QualityModel, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = TokenNumbers(model.vocabulary)
        for batch in batches:
            scores = scores_of(batch.column("text").to_pylist(), numbers, model)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(scores, pa.float64())], names=[*columns, "score"]
            )

    return run


def score(docs: DataFrame, model: QualityModel | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``score`` and ``predicted``; only they and the text reach Python."""
    if model is None:
        scored = docs.select(*keep, F.lit(0.5).alias("score"))
    else:
        columns = [f"c{i}" for i in range(len(keep))]
        rows = docs.select("text", *[F.col(c).alias(a) for c, a in zip(keep, columns, strict=True)])
        done = rows.mapInArrow(frugal(score_batches(model, columns)), rows.drop("text").schema.add("score", "double"))
        scored = done.select(*[F.col(a).alias(c) for c, a in zip(keep, columns, strict=True)], "score")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def accept_batches(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = TokenNumbers(model.vocabulary)
        for batch in batches:
            yield batch.filter(pa.array(scores_of(batch.column("text").to_pylist(), numbers, model) >= THRESHOLD))

    return run


def accepted(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """The documents with a score of at least ``THRESHOLD``, all columns unchanged."""
    return docs if model is None else docs.mapInArrow(frugal(accept_batches(model)), docs.schema)


def assess(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted``; learns from labels of rows that are not held out."""
    out = held_out(F.col("doc_id"), 5, 0)
    model = learn(docs, labels.select("doc_id", F.col("quality").alias("label")).where(~out), most)
    return score(docs, model, ["doc_id"]).select("doc_id", out.alias("held_out"), "score", "predicted")
