"""Collocations by marginalising the longest windows.

Every word of a piece begins one window of up to ``LONGEST`` words, padded with
nulls where the piece ends.  Only these windows are counted; the counts of
all shorter phrases are sums over windows with the same first words, which one
ROLLUP gives: no phrase length is exploded on its own.

Windows are cut where a longer phrase cannot be frequent: a phrase occurs at
most as often as its words, pairs and triples of neighbours.  Passes before the
windows find the words, then the pairs, then the triples that reach the least
count.  What they hand on is a bit per hash value, a table of fixed size: another
word of the same hash value lets a window be longer than it must be, never
shorter, so counts that reach the least count are exact, whatever the table's size.

Each task counts its own words, pairs and windows batch by batch before the
shuffle, so a very frequent word is one row per task.  Texts are read in bytes and
in slices, so long ones cost their word numbers (4 bytes a word) only.

Edge cases: a null text is empty; a null language is ``und``; repeated rows
count each; a language without frequent phrases has no rows; an empty table
gives no rows.  Columns other than ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpair.llm.common import stored
from textpair.session import ship_package

# Fixed by contract: phrase lengths, least count, score factor, share of a longer phrase, rows per language.
LONGEST = 4
LEAST = 30
SCALE = 2_000_000
INSIDE = 80
TOP = 2000
NO_LANGUAGE = "und"

# Bits of the tables that mark frequent words, pairs and triples: 2, 16 and 16 MB, whatever the corpus.
BITS = (24, 27, 27)
# Bits of the hash under which pairs and triples are counted.
RUN_BITS = 40
# A task hands counts on when it holds so many words, pairs or windows.
HELD = 1 << 20
SLICE = 1 << 22

WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
BREAK = b"\xff"  # no byte of UTF-8: stands for the end of a piece


def byte_table() -> bytes:
    """Lower-case A-Z, tabs to spaces, ends of pieces to ``BREAK``."""
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = BREAK[0]
    table[ord("\t")] = ord(" ")
    return bytes(table)


TABLE = byte_table()


def tokens(text: str) -> Iterator[list[bytes]]:
    """Words and breaks of a text, slice by slice."""
    data = text.encode()
    start = 0
    while start < len(data):
        end = start + SLICE
        if end < len(data):
            # A slice ends behind a byte that no word holds.
            cut = max(data.rfind(c, start, end) for c in (b" ", b"\n", b".", b","))
            if cut < 0:
                found = [p for p in (data.find(c, end) for c in (b" ", b"\n", b".", b",")) if p >= 0]
                cut = min(found, default=len(data))
            end = cut + 1
        yield data[start:end].translate(TABLE).replace(BREAK, b" \xff ").split()
        start = end


def word_hash(lang: str, word: bytes) -> int:
    """What Spark's ``xxhash64(lang, word)`` gives, unsigned."""
    return xxhash.xxh64_intdigest(word, seed=xxhash.xxh64_intdigest(lang.encode(), seed=42))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            if (value := text.as_py()):
                yield lang.as_py(), value


WORD_COUNTS = "lang string, word string, n long"


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            words.pop(BREAK, None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(words), pa.string()), pa.array([w.decode() for w in words], pa.string()),
                    pa.array(list(words.values()), pa.int64()),
                ],
                names=["lang", "word", "n"],
            )
        counts.clear()

    for lang, text in rows_of(batches):
        for part in tokens(text):
            counts.setdefault(lang, Counter()).update(part)
            if sum(map(len, counts.values())) > HELD:
                yield from out()
    yield from out()


class Numbers:
    """Numbers of a language's words: 0 is a break and every word that is not frequent."""

    def __init__(self, lang: str, words: np.ndarray) -> None:
        self.lang, self.frequent = lang, words
        self.clear()

    def clear(self) -> None:
        self.of: dict[bytes, int] = {BREAK: 0}
        self.words: list[bytes] = [b""]
        self.hashes = [0]
        self.table = np.zeros(1, np.uint64)

    def add(self, word: bytes) -> int:
        value = word_hash(self.lang, word)
        number = 0
        if is_marked(self.frequent, value):
            number = len(self.words)
            self.words.append(word)
            self.hashes.append(value)
        self.of[word] = number
        return number

    def numbered(self, text: str) -> np.ndarray:
        """The numbers of a text's words, with a break behind it."""
        known = self.of
        parts = []
        for part in tokens(text):
            for word in set(part).difference(known):
                self.add(word)
            parts.append(np.fromiter(map(known.__getitem__, part), np.int32, len(part)))
        return np.concatenate([*parts, np.zeros(1, np.int32)])

    def run_hashes(self, ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """A hash of the run of so many words at each start."""
        if len(self.table) != len(self.hashes):
            self.table = np.array(self.hashes, np.uint64)
        h = self.table[ids[starts]]
        for k in range(1, length):
            h = h * np.uint64(0x9E3779B97F4A7C15) ^ self.table[ids[starts + k]]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))) & np.uint64((1 << RUN_BITS) - 1)


def is_marked(bits: np.ndarray, hashes):
    """Whether the bit of a hash value, or of each of an array, is set."""
    places = hashes & (8 * len(bits) - 1) if isinstance(hashes, int) else (hashes & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[places >> 3] >> (places & 7)) & 1 == 1


def batched(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[tuple[Numbers, np.ndarray]]:
    """Word numbers of about ``HELD`` words of one language at a time; numbers hold until the next item."""
    numbers: dict[str, Numbers] = {}
    held: dict[str, list[np.ndarray]] = {}
    sizes: Counter = Counter()
    for lang, text in rows_of(batches):
        if lang not in numbers:
            numbers[lang] = Numbers(lang, words)
        own = numbers[lang]
        held.setdefault(lang, []).append(own.numbered(text))
        sizes[lang] += len(held[lang][-1])
        if sizes[lang] > HELD:
            del sizes[lang]
            yield own, np.concatenate(held.pop(lang))
            if len(own.of) > HELD:
                own.clear()
    for lang, parts in held.items():
        yield numbers[lang], np.concatenate(parts)


RUN_COUNTS = "hash long, n long"


def possible_runs(numbers: Numbers, ids: np.ndarray, tables: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For 2 words, then 3 and so on: whether each place begins a run that can be frequent.

    Both runs of one word less must be; where there is a table for the length, the run must be marked too.
    """
    shorter = ids > 0
    for length in range(2, len(tables) + 3):
        both = np.zeros(len(ids), bool)
        both[:-1] = shorter[:-1] & shorter[1:]
        if length - 2 < len(tables):
            starts = np.flatnonzero(both)
            both[starts] = is_marked(tables[length - 2], numbers.run_hashes(ids, starts, length))
        yield both
        shorter = both


def count_runs(words: Broadcast, tables: list[Broadcast]):
    """Counts of the runs one word longer than those of the last table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [t.value for t in tables]
        for numbers, ids in batched(batches, words.value):
            starts = np.flatnonzero(list(possible_runs(numbers, ids, known))[-1])
            hashes, n = np.unique(numbers.run_hashes(ids, starts, len(known) + 2), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"]
            )

    return run


WINDOWS = "lang string, " + ", ".join(f"{w} string" for w in WORDS) + ", n long"


def count_windows(words: Broadcast, tables: list[Broadcast]):
    """Each frequent word's window, as far as it can be frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [t.value for t in tables]
        for numbers, ids in batched(batches, words.value):
            reaches = list(possible_runs(numbers, ids, known))
            singles = np.bincount(ids[~reaches[0]], minlength=len(numbers.words))
            yield from window_batch(numbers, [np.arange(1, len(singles))], singles[1:])
            starts = np.flatnonzero(reaches[0])
            padded = np.concatenate([ids, np.zeros(LONGEST, np.int32)])
            columns = [padded[starts]]
            for k, reach in enumerate(reaches, 1):
                columns.append(np.where(reach[starts], padded[starts + k], 0))
            windows, n = distinct(columns)
            yield from window_batch(numbers, windows, n)

    return run


def distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of four columns of numbers and how often each occurs."""
    first, second = (a.astype(np.int64) << 32 | b for a, b in (columns[:2], columns[2:]))
    lefts, left_at = np.unique(first, return_inverse=True)
    rights, right_at = np.unique(second, return_inverse=True)
    both, n = np.unique(left_at.astype(np.int64) << 32 | right_at, return_counts=True)
    left, right = lefts[both >> 32], rights[both & 0xFFFFFFFF]
    return [left >> 32, left & 0xFFFFFFFF, right >> 32, right & 0xFFFFFFFF], n


def window_batch(numbers: Numbers, columns: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    kept = n > 0
    if not kept.any():
        return
    names = pa.array([None, *(w.decode() for w in numbers.words[1:])], pa.string())
    rows = [names.take(pa.array(c[kept])) for c in columns]
    size = int(kept.sum())
    rows += [pa.nulls(size, pa.string())] * (LONGEST - len(rows))
    yield pa.RecordBatch.from_arrays(
        [pa.array([numbers.lang] * size), *rows, pa.array(n[kept].astype(np.int64))], names=["lang", *WORDS, "n"]
    )


def marks(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for every hash value, ``2 ** bits`` of them: all the driver and a task see of frequent words or pairs."""
    place = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1).cast("long")) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    table = np.zeros((1 << bits) // 8, np.uint8)
    for part, piece in parts.collect():
        piece = np.frombuffer(piece, np.uint8)[: len(table)]
        table[(part - 1) * 4096 : (part - 1) * 4096 + len(piece)] = piece
    return table


def phrase_counts(docs: DataFrame, least: int = LEAST, bits: tuple[int, int, int] = BITS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, f`` of phrases of 1 to 4 words with f >= least, and ``lang, n`` of all words."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce(F.col("lang"), F.lit(NO_LANGUAGE)).alias("lang"), "text")
    words = stored(texts.mapInArrow(count_words, WORD_COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least).select(F.xxhash64("lang", "word").alias("hash"))
    word_marks = spark.sparkContext.broadcast(marks(frequent, bits[0]))
    tables: list[Broadcast] = []
    for size in bits[1:]:
        runs = texts.mapInArrow(count_runs(word_marks, tables), RUN_COUNTS).groupBy("hash").agg(F.sum("n").alias("n"))
        tables = [*tables, spark.sparkContext.broadcast(marks(runs.where(F.col("n") >= least).select("hash"), size))]
    windows = stored(
        texts.mapInArrow(count_windows(word_marks, tables), WINDOWS).groupBy("lang", *WORDS).agg(F.sum("n").alias("n")),
        "windows",
    )
    rolled = windows.rollup("lang", *WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("_level"))
    counted = rolled.where(F.col("f") >= least)
    # At level k the first k words are grouped; a padded word ends the phrase before.
    k = LONGEST - F.bit_count("_level")
    last = F.element_at(F.array(*WORDS), F.greatest(k, F.lit(1)).cast("int"))
    phrases = counted.where((k >= 1) & last.isNotNull() & F.col("lang").isNotNull()).select(
        "lang", F.concat_ws(" ", *WORDS).alias("phrase"), k.cast("int").alias("k"), "f"
    )
    return stored(phrases, "phrases"), totals


def weakest_cuts(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, k, a, l, r, score`` of every candidate at its lowest-scoring cut."""
    split = F.split("phrase", " ")
    cuts = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    pieces = phrases.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), cuts.alias("cut")).select(
        "*", F.array_join(F.slice(split, F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(split, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"),
    )
    first = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rest = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    # Decimals: the product may need more than 64 bits, `div` is exact.
    score = F.expr(f"cast({SCALE} as decimal(8,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = pieces.join(first, ["lang", "left"]).join(rest, ["lang", "right"]).withColumn("score", score)
    return (
        scored.groupBy("lang", "phrase", "k", "a")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("cut"))
        .select("lang", "phrase", "k", "a", "cut.l", "cut.r", "cut.score")
    )


def inner_phrases(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, longer``: the most frequent longer candidate around each phrase of two words or more."""
    split = F.split("phrase", " ")

    def inside(length: int) -> Column:
        """All phrases of so many neighbouring words."""
        starts = F.sequence(F.lit(1), F.col("k") - length + 1)
        return F.when(F.col("k") > length, F.transform(starts, lambda i: F.array_join(F.slice(split, i, F.lit(length)), " "))).otherwise(F.array())

    parts = F.concat(*[inside(length).cast("array<string>") for length in range(2, LONGEST)])
    return phrases.where("k >= 3").select("lang", F.explode(parts).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, bits: tuple[int, int, int] = BITS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first phrases."""
    phrases, totals = phrase_counts(docs, least, bits)
    covered = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * INSIDE
    kept = weakest_cuts(phrases).join(inner_phrases(phrases), ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | ~covered
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
