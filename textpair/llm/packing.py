"""Pack documents into training windows with a fixed mixture of sources.

Each source is a queue of tokens: its documents in table order, each followed
by the end token.  Deficit round-robin fills the windows: in every window a
queue earns credit for its share of the window, sends as many whole tokens as
its credit allows and carries the rest of the credit into the next window.
Shares are the caller's targets; by default they are proportional to the
queues, so that all of them last to the end.  Only the last window has padding.

The credit that a queue carries has a closed form, because shares are constant:
before window w the first j queues together have sent
``floor(w * length * tokens_of_first_j / tokens_of_all)`` tokens.  So any task
knows the state at any window and places its documents without hearing of the
others; deficits carry over windows and over partitions alike.

With ``targets`` a queue may run dry before the others.  Its credit then goes to
those that still have tokens, in proportion to their shares, so the packing is
a row of phases with constant shares, at most one per queue.  The phases follow
from the queues' sizes alone and each has the closed form; a window across the
end of a phase holds the end of one and the beginning of the next.  All tokens
are packed: what outlasts every target comes last.  At the end of a phase a
queue's credit is below one token and is dropped.  Sources without a target are
one queue, whose share is what the targets leave of 1; if that is nothing, it
follows when all others are dry.

Without targets, sources with less than one token per window share one queue (if that still has
less than one, it continues the smallest other queue), so at most ``length``
queues exist and their table is of bounded size whatever the corpus.

One pass tokenises and writes the ids, 2 bytes each, with each document's
place among its source's tokens of that partition; sums per partition and
source give the places in the queues.  A second pass over the stored ids cuts.

With ``special_tokens`` the string ``<|endoftext|>`` in a text is its own id, as
the ``tokenizers`` reader of ``byte_bpe_50k.json`` gives it; else it is ordinary
text.  The op6 query and the pipeline stage set it.

Edge cases: a null or empty text is its end token alone; a null source is a
source; repeated rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator, Mapping
from fractions import Fraction
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpair.llm.common import frugal, resident, stored, text_key
from textpair.session import ship_package

LENGTH = 1024
END_TOKEN = 0
# The ranks of the vocabulary in byte_bpe_50k.json, as tiktoken reads them.
RANKS = "byte_bpe_50k.tiktoken"
# The one added token of byte_bpe_50k.json: texts are cut at it and each part is encoded on its own.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

TOKENS = "doc_id long, queue_key string, part int, before long, tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "padded_length long"
)


def encoder(path: str) -> Callable[[str], list[int]]:
    return resident(f"encoder:{path}", lambda: read_encoder(path))


def read_encoder(path: str) -> Callable[[str], list[int]]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return encoding.encode_ordinary


def token_ids(text: str, encode: Callable[[str], list[int]]) -> bytes:
    """Ids of a whole text as 2-byte integers.

    The reader takes the text in one call: looking words up one by one costs more than it saves.
    """
    ids = array("H", encode(text))
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def special_ids(text: str, encode: Callable[[str], list[int]]) -> bytes:
    """Like ``token_ids``, with ``SPECIAL`` as its own id."""
    if SPECIAL not in text:
        return token_ids(text, encode)
    own = np.array([SPECIAL_ID], "<u2").tobytes()
    return own.join([token_ids(part, encode) for part in text.split(SPECIAL)])


def tokenise_batches(path: str, special_tokens: bool = False):
    ids_of = special_ids if special_tokens else token_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        part = TaskContext.get().partitionId()
        sent: dict[str, int] = {}
        end = np.array([END_TOKEN], "<u2").tobytes()
        for batch in batches:
            keys = batch.column("queue_key").to_pylist()
            ids = [ids_of(text or "", encode) + end for text in batch.column("text").to_pylist()]
            before, counts = [], []
            for key, own in zip(keys, ids, strict=True):
                before.append(sent.get(key, 0))
                counts.append(len(own) // 2)
                sent[key] = before[-1] + counts[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), batch.column("queue_key").cast(pa.string()),
                    pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()),
                    pa.array(counts, pa.int64()), pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "queue_key", "part", "before", "tokens", "ids"],
            )

    return run


def tokenised(docs: DataFrame, path: str, special_tokens: bool = False) -> DataFrame:
    """Ids of every document and its place in its partition's part of its source."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs["source"]).alias("queue_key"), "text")
    return rows.mapInArrow(frugal(tokenise_batches(path, special_tokens)), TOKENS)


def queues(totals: DataFrame, length: int, named: list[str] | None = None) -> tuple[list[tuple[str | None, int]], int]:
    """``(key, tokens)`` of each queue in order of key, and the number of tokens.

    The shared queue has the key None.  At most ``length`` sources have a token
    per window or are ``named``, so what is collected is bounded.
    """
    sources = totals.groupBy("queue_key").agg(F.sum("tokens").alias("tokens"))
    everything = sources.agg(F.sum("tokens")).first()[0] or 0
    own = F.col("tokens") * length >= everything if named is None else F.col("queue_key").isin(named)
    large = sources.where(own).orderBy("queue_key").collect()
    sizes: list[tuple[str | None, int]] = [(r["queue_key"], r["tokens"]) for r in large]
    rest = everything - sum(n for _, n in sizes)
    if rest:
        sizes.append((None, rest))
    return sizes, everything


def target_shares(targets: Mapping[str | None, float], length: int) -> tuple[dict[str, Fraction], Fraction]:
    """Exact shares by queue key, and what they leave to the other sources; below one token a window raises."""
    shares = {"" if source is None else f"={source}": Fraction(share) for source, share in targets.items()}
    left = 1 - sum(shares.values())
    if abs(left) < Fraction(1, 10**9):
        left = Fraction(0)
    if left < 0:
        raise ValueError("the target shares add up to more than 1")
    if any(share * length < 1 for share in shares.values()) or 0 < left * length < 1:
        raise ValueError(f"a target share gives less than one token in a window of {length}")
    return shares, left


def phases(sizes: list[int], shares: list[Fraction]) -> list[tuple[int, list[int]]]:
    """``(begin, tokens of each queue)`` of the spans of tokens in which shares are constant."""
    rest, begin, out = list(sizes), 0, []
    while any(rest):
        weights = [share if n else Fraction(0) for n, share in zip(rest, shares, strict=True)]
        if not any(weights):
            weights = [Fraction(n) for n in rest]
        time = min(n / w for n, w in zip(rest, weights, strict=True) if w)
        sent = [int(time * w) for w in weights]
        out.append((begin, sent))
        begin += sum(sent)
        rest = [n - m for n, m in zip(rest, sent, strict=True)]
    return out


def queue_spans(sizes: list[int], plan: list[tuple[int, list[int]]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Of each queue ``(start in the queue, tokens, tokens of queues before it, tokens of all, begin)`` by phase."""
    spans: dict[int, list[tuple[int, int, int, int, int]]] = {i: [] for i in range(len(sizes))}
    starts = [0] * len(sizes)
    for begin, sent in plan:
        lows = [0, *accumulate(sent)]
        for i, own in enumerate(sent):
            if own:
                spans[i].append((starts[i], own, lows[i], lows[-1], begin))
                starts[i] += own
    return spans


def sent_before(windows, tokens: int, everything: int, length: int, begin: int = 0):
    """Tokens that queues with ``tokens`` tokens together have sent before each window; exact at any size."""
    windows = np.asarray(windows)
    if everything < 2**31:
        reached = np.clip(windows.astype(np.int64) * length - begin, 0, everything)
        return reached * tokens // everything
    return np.array([min(max(int(w) * length - begin, 0), everything) * tokens // everything for w in windows], np.int64)


def cut_document(at: int, count: int, low: int, own: int, everything: int, length: int, begin: int = 0):
    """Windows, starts in the document and offsets in the windows of a document's pieces.

    The document is tokens ``at`` to ``at + count`` of the queue that has
    ``own`` tokens after the ``low`` tokens of the queues before it, in a phase
    that begins behind ``begin`` tokens.
    """
    first = max((begin + at * everything // own) // length - 4, begin // length)
    last = (begin + (at + count) * everything // own) // length + 5
    windows = np.arange(first, last + 1)
    below = sent_before(windows, low, everything, length, begin)
    upto = sent_before(windows, low + own, everything, length, begin)
    bounds = upto - below
    keep = (bounds[1:] > at) & (bounds[:-1] < at + count) & (bounds[1:] > bounds[:-1])
    starts = np.maximum(bounds[:-1], at)[keep]
    ends = np.minimum(bounds[1:], at + count)[keep]
    offsets = (below[1:] - below[:-1])[keep] + starts - bounds[:-1][keep]
    windows = windows[:-1][keep]
    return windows, starts - at, ends - starts, offsets + np.maximum(begin - windows * length, 0)


def cut_spans(at: int, count: int, spans: list[tuple[int, int, int, int, int]], length: int):
    """``cut_document`` over the phases in which the queue sends the document."""
    inside = [span for span in spans if span[0] < at + count and at < span[0] + span[1]] if len(spans) > 1 else spans
    parts = []
    for start, own, low, everything, begin in inside:
        skipped = max(start - at, 0)
        upto = min(at + count, start + own) - at
        windows, starts, lengths, offsets = cut_document(at + skipped - start, upto - skipped, low, own, everything, length, begin)
        parts.append((windows, starts + skipped, lengths, offsets))
    return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts, strict=True)))


def cut_batches(spans: dict, everything: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (everything - 1) // length
        tail = everything - last * length
        shortest = length if tail == length else min(length, 1 << (tail - 1).bit_length())
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            rows = zip(
                batch.column("doc_id").to_pylist(), batch.column("queue").to_pylist(),
                batch.column("at").to_pylist(), batch.column("tokens").to_pylist(),
                batch.column("ids").to_pylist(), strict=True,
            )
            for doc_id, queue, at, count, ids in rows:
                windows, starts, lengths, offsets = cut_spans(at, count, spans[queue], length)
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                view = memoryview(wide)
                out[0] += [doc_id] * len(starts)
                out[1].append(starts)
                out[2].append(lengths)
                out[3] += [zlib.crc32(view[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                out[4] += [count] * len(starts)
                out[5].append(windows)
                out[6].append(offsets)
                if len(out[0]) >= 100_000:
                    yield piece_batch(out, last, shortest, length)
                    out = [[] for _ in range(7)]
            yield piece_batch(out, last, shortest, length)

    return run


def piece_batch(out: list[list], last: int, shortest: int, length: int) -> pa.RecordBatch:
    joined = [np.concatenate(x) if x and isinstance(x[0], np.ndarray) else x for x in out]
    windows = np.asarray(joined[5], np.int64)
    padded = np.where(windows == last, shortest, length)
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in (*joined, padded)],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"],
    )


def pack(
    docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, special_tokens: bool = False,
    targets: Mapping[str | None, float] | None = None,
) -> DataFrame:
    """The pieces of all documents: where each lies in its document and in its window.

    ``padded_length`` is ``length``, in the last window the next power of two.
    ``targets`` are shares of a window by source, at least one token each and
    together at most 1; without them the shares are those of all tokens.  A
    target whose source has no document leaves its share to the others.
    """
    spark = docs.sparkSession
    shares, left = target_shares(targets or {}, length)
    ship_package(spark)
    tokens = stored(tokenised(docs, tokenizer or public_tokenizers.path(RANKS), special_tokens), "tokens")
    totals = stored(tokens.groupBy("part", "queue_key").agg(F.sum("tokens").alias("tokens")), "token-totals")
    sizes, everything = queues(totals, length, None if targets is None else list(shares))
    if not everything:
        return spark.createDataFrame([], PIECES)

    # Queue numbers; the shared queue follows the others.  One too small for a
    # token per window continues the smallest queue.
    numbers = {key: i for i, (key, _) in enumerate(sizes)}
    counts = [n for _, n in sizes]
    shared = numbers.get(None, len(sizes))
    offset = 0
    if targets is None and len(sizes) > 1 and None in numbers and counts[shared] * length < everything:
        host = min(range(shared), key=counts.__getitem__)
        offset = counts[host]
        counts[host] += counts.pop()
        shared = host
    if targets is None:
        plan = [(0, counts)]
    else:
        plan = phases(counts, [left if key is None else shares[key] for key, _ in sizes])
    spans = queue_spans(counts, plan)

    own = [F.lit(x) for key, i in numbers.items() if key is not None for x in (key, i)]
    mine = F.element_at(F.create_map(*own), F.col("queue_key")) if own else F.lit(None).cast("int")
    queued = totals.withColumn("own", mine)
    # Places of partitions in their queue; one row per partition and source.
    earlier = Window.partitionBy("own").orderBy("part", "queue_key").rowsBetween(Window.unboundedPreceding, -1)
    bases = queued.select(
        "part", "queue_key", F.coalesce("own", F.lit(shared)).alias("queue"),
        (F.coalesce(F.sum("tokens").over(earlier), F.lit(0)) + F.when(F.col("own").isNull(), offset).otherwise(0)).alias("base"),
    )
    placed = tokens.join(bases, ["part", "queue_key"]).select(
        "doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "tokens", "ids"
    )
    return placed.mapInArrow(frugal(cut_batches(spans, everything, length)), PIECES)
