"""Subword tokens by a public byte-pair vocabulary.

The vocabulary is a file of ranks (base64 bytes, rank) whose path is given; no
tokenizer is trained here.  Texts are cut into pieces by Spark's own regular
expressions; a task then applies the merge ranks once to each distinct
piece of a batch and puts the ids together by position.  Nothing is
shuffled: the rank table has a checked size and goes to every task, so the
frequent pieces of a corpus never meet in one place.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpair.functions.text import _col
from textpair.operators.vocab import MAX_INPUT, MAX_LABEL

# Fixed value: how texts are cut into pieces before merging, as published with the vocabulary.  (?U) gives \s the
# meaning it has there.
PIECE = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Largest vocabulary that is sent to every task; a larger file raises.
MOST_RANKS = 1_000_000
# Distinct pieces a task remembers, and the longest (in bytes) of them.
REMEMBERED = 200_000
REMEMBERED_BYTES = 64
# Pieces of at most so many bytes are merged without a queue.
SHORT = 48


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """``(token binary, id)`` of a rank file: one base64 token and its rank a line."""
    parts = F.split("value", " ")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.unbase64(parts[0]).alias("token"), parts[1].cast("int").alias("id"))


def subword_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``(token, id)`` of the vocabulary and its closing token ``</s>``, whose id is the first free one.

    Tokens are shown as hexadecimal bytes, as many are no whole characters.
    """
    ranks = read_ranks(spark, path)
    closing = ranks.agg((F.max("id") + 1).alias("id")).select(F.lit("</s>").alias("token"), "id")
    return ranks.select(F.hex("token").alias("token"), "id").unionByName(closing)


class Subwords:
    """A vocabulary ready for use in tasks: ``table`` maps bytes to ids, ``eos`` closes a sequence."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        rows = read_ranks(spark, path).limit(MOST_RANKS + 1).collect()
        if len(rows) > MOST_RANKS:
            raise ValueError(f"{path} has more than {MOST_RANKS} tokens")
        ranks = {bytes(r["token"]): r["id"] for r in rows}
        if len(ranks) != len(rows) or len(set(ranks.values())) != len(rows) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"{path} must list every byte, and each token and rank once")
        self.eos = max(ranks.values()) + 1
        self.table: Broadcast = spark.sparkContext.broadcast(ranks)


def pieces(c: Column | str) -> Column:
    """The pieces of a text, in order; joined they are the text.  Null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(PIECE), F.lit(0))


def merged_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a piece of few bytes, where looking at all neighbours each time is quicker than a queue."""
    part = [piece[i : i + 1] for i in range(len(piece))]
    none = 1 << 62
    near = [ranks.get(a + b, none) for a, b in zip(part, part[1:])]
    while near:
        rank = min(near)
        if rank == none:
            break
        i = near.index(rank)
        part[i : i + 2] = [part[i] + part[i + 1]]
        del near[i]
        if i:
            near[i - 1] = ranks.get(part[i - 1] + part[i], none)
        if i < len(near):
            near[i] = ranks.get(part[i] + part[i + 1], none)
    return [ranks[p] for p in part]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the neighbours of lowest rank merge first, the leftmost of equal ones.

    A queue of possible merges over linked parts: n log n steps for a piece of n bytes.
    """
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) <= SHORT:
        return merged_short(piece, ranks)
    part = [piece[i : i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    queue = [(ranks[part[i] + part[i + 1]], i) for i in range(len(part) - 1) if part[i] + part[i + 1] in ranks]
    heapq.heapify(queue)
    while queue:
        rank, i = heapq.heappop(queue)
        j = after[i]
        # An entry is stale where one of its parts has merged since.
        if not part[i] or j >= len(part) or ranks.get(part[i] + part[j]) != rank:
            continue
        part[i], part[j] = part[i] + part[j], b""
        after[i] = after[j]
        if after[j] < len(part):
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < len(part) and part[left] + part[right] in ranks:
                heapq.heappush(queue, (ranks[part[left] + part[right]], left))
    return [ranks[p] for p in part if p]


def spread(codes: np.ndarray, values: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """``values[code]`` of every code one after the other, and the lengths."""
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.fromiter((x for v in values for x in v), np.int32, int(lengths.sum()))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(values) else lengths
    each = lengths[codes]
    ends = np.cumsum(each)
    places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - each, each) + np.repeat(starts[codes], each)
    return flat[places], each


def piece_ids(table: Broadcast):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks, known = table.value, {}
        for batch in batches:
            flat = batch.flatten().dictionary_encode()
            values = []
            for piece in flat.dictionary.to_pylist():
                found = known.get(piece)
                if found is None:
                    data = piece.encode()
                    found = merged(data, ranks)
                    if len(data) <= REMEMBERED_BYTES:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[piece] = found
                values.append(found)
            made, each = spread(flat.indices.to_numpy(), values)
            ends = np.concatenate([[0], np.cumsum(each)])
            counts = np.asarray(pc.fill_null(pc.list_value_length(batch), 0), np.int64)
            offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
            yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(made, pa.int32()))

    return ids


def subword_ids(c: Column | str, words: Subwords, most: int | None = None) -> Column:
    """Ids of a text without a closing token; ``most`` cuts them.

    Every piece has one id at least, so pieces beyond ``most`` are not even encoded.
    """
    cut = pieces(c) if most is None else F.slice(pieces(c), 1, most)
    ids = piece_ids(words.table)(cut)
    return ids if most is None else F.slice(ids, 1, most)


def encode_subwords(
    df: DataFrame,
    words: Subwords,
    input_col: str = "input_text",
    label_col: str = "short_query",
    key: str = "product_id",
    max_input: int = MAX_INPUT,
    max_label: int = MAX_LABEL,
) -> DataFrame:
    """``(key, input_ids, attention_mask, labels)``: ids cut so that, with the closing one, lengths stay in their limits."""
    ids = df.select(
        key,
        F.array_append(subword_ids(input_col, words, max_input - 1), F.lit(words.eos)).alias("input_ids"),
        F.array_append(subword_ids(label_col, words, max_label - 1), F.lit(words.eos)).alias("labels"),
    )
    return ids.select(key, "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"), "labels")


def tokens_by_id(table: Broadcast) -> pa.Array:
    """The bytes of every id, by id; ids that are none have no bytes."""
    tokens = [b""] * (max(table.value.values()) + 1)
    for token, i in table.value.items():
        tokens[i] = token
    return pa.array(tokens, pa.binary())


def joined(lists: pa.Array, tokens: pa.Array) -> list[str]:
    """The texts of lists of ids: their bytes are looked up and laid one after the other for all rows at once."""
    ids = lists.flatten()
    known = pc.fill_null(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(tokens))), False)
    found = pc.fill_null(tokens.take(pc.if_else(known, ids, None)), b"")
    ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1, found.offset * 4) if len(found) else np.zeros(1, np.int32)
    data = memoryview(found.buffers()[2] or b"")
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    cuts = ends[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [str(data[a:b], "utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


def decode_subwords(df: DataFrame, words: Subwords, ids_col: str = "labels", key: str = "product_id", out: str = "text") -> DataFrame:
    """``(key, out)``: ids back to text; closing, ignored and unknown ids are left out, null gives an empty text.

    Bytes of a character that a cut has split become the replacement character.
    """
    table = words.table

    @F.arrow_udf(T.StringType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = tokens_by_id(table)
        for batch in batches:
            yield pa.array(joined(batch, tokens), pa.string())

    return df.select(key, text(F.coalesce(ids_col, F.array().cast("array<int>"))).alias(out))
