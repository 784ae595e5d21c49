"""Near-duplicates by MinHash.

1. One pass over the texts makes a sketch per document: the number of distinct
   word shingles, a 128-bit key of the whole set, up to ``MINIMA`` universal
   hash minima (16 bits of each are kept) and one key per band of minima.
2. Documents with equal sets form one class; everything after that works on
   classes, so copies cost nothing.
3. Classes that share a band key are candidates.  Every member of a bucket is
   tied to its smallest member, and these ties are closed to clusters: a bucket
   of any size gives as many ties as members, never its pairs.
4. Clusters are cut into blocks of bounded size and every two blocks of a
   cluster meet in one task.  There a pair passes if enough minima agree and
   then if the full sets, rebuilt from the texts of candidates, have the wanted
   similarity; what leaves the task is a forest of the links, so pairs are
   neither shuffled nor written.
5. Links are closed to components by alternating large-star and small-star.

The wanted similarity is a parameter; bands and the bound on agreeing minima
follow from it.  For 0.85 there are 32 bands of 6 minima, for 0.80 there are 38
of 5: two sets of just that similarity share no band with probability 3e-7, and
miss the bound with 1e-6.

Edge cases: a null or empty text, or one of white space, has no shingles and is
linked with nothing; fewer than five words are one shingle; a row without an id
is linked like any other and takes the smallest id of its component; where no
row of a component has an id, the component is null and its rows are kept;
repeated rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpair.llm.common import frugal, give_back, resident, stored
from textpair.llm.components import connected_components
from textpair.session import ship_package

SHINGLE = 5
PERCENT = 85
MINIMA = 192
# A pair of just the wanted similarity shares no band with this probability at most.
MISSED = 1e-6
REMEMBERED_WORDS = 400_000
BLOCK = 512
# A block of a cluster has about so many classes and shingles at most.
BLOCK_CLASSES = 1024
BLOCK_SHINGLES = 1_000_000
# Columns of a product of 0/1 matrices at a time.
PRODUCT_COLUMNS = 4096

_random = np.random.Generator(np.random.PCG64(20240229))
MULTIPLIERS = _random.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 2**63, MINIMA, dtype=np.uint64)
PLACES = _random.integers(1, 2**63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_SALTS = _random.integers(0, 2**63, MINIMA, dtype=np.uint64)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

SKETCH = "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>, minima binary"


@dataclass(frozen=True)
class Bands:
    """How minima are banded to find the pairs of ``percent`` similarity or more."""

    percent: int
    count: int
    rows: int
    least_agreeing: int  # minima that a pair of just that similarity reaches but for 1e-6

    @property
    def minima(self) -> int:
        return self.count * self.rows


def bands_for(percent: int) -> Bands:
    """The longest bands that miss a pair of ``percent`` similarity with ``MISSED`` at most."""
    share = percent / 100
    for rows in range(len(PLACES), 0, -1):
        count = MINIMA // rows
        if (1 - share**rows) ** count <= MISSED:
            n = count * rows
            return Bands(percent, count, rows, int(n * (share - 4.75 * (share * (1 - share) / n) ** 0.5)))
    raise ValueError(f"{MINIMA} minima do not find pairs of {percent} percent similarity")


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes() -> WordHashes:
    return resident("word-hashes", WordHashes)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    hashed = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    count = len(words) - SHINGLE + 1
    total = np.zeros(count, np.uint64)
    for i in range(SHINGLE):
        total += mixed(hashed[i : i + count] + PLACES[i]) * PLACES[i]
    return np.unique(mixed(total))


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def minima(shingles: np.ndarray, count: int) -> np.ndarray:
    """The smallest value of each of ``count`` universal hashes over a set; memory is bounded by blocks."""
    least = np.full(count, 2**64 - 1, np.uint64)
    for start in range(0, len(shingles), BLOCK):
        values = np.multiply.outer(MULTIPLIERS[:count], shingles[start : start + BLOCK])
        values += OFFSETS[:count, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least >> np.uint64(32)


def band_keys(least: np.ndarray, bands: Bands) -> np.ndarray:
    rows = least.reshape(bands.count, bands.rows)
    return mixed((rows * PLACES[: bands.rows]).sum(axis=1, dtype=np.uint64) + BAND_SALTS[: bands.count]).view(np.int64)


def sketch_batches(banding: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, nodes, bands, kept = [], [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text)
                counts.append(len(shingles))
                if len(shingles):
                    least = minima(shingles, banding.minima)
                    nodes.append(set_key(shingles))
                    bands.append(band_keys(least, banding))
                    kept.append(least.astype(np.uint16).tobytes())
                else:
                    nodes.append(None)
                    bands.append(None)
                    kept.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "node", "bands", "minima"],
            )

    return run


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["node", "shingles"],
        )


def likely_pairs(least: np.ndarray, blocks: np.ndarray, least_agreeing: int) -> np.ndarray:
    """Pairs of rows of which enough minima agree; between different blocks, if there are two."""
    agreeing = np.zeros((len(least), len(least)), np.uint8)
    for column in least.T:
        agreeing += column[:, None] == column[None, :]
    mask = np.triu(agreeing >= least_agreeing, 1)
    if blocks[0] != blocks[-1]:
        mask &= blocks[:, None] != blocks[None, :]
    return np.argwhere(mask)


def intersections(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Exact sizes of the pairs' intersections.

    A few pairs are intersected one by one.  Many pairs of the same sets are
    counted together, as a product of 0/1 matrices over the shingles that at
    least two of the sets have.
    """
    if len(pairs) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs], np.int64)
    every = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    owners, number = owners[shared], np.unique(number[shared], return_inverse=True)[1]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(number.max(initial=-1)) + 1, PRODUCT_COLUMNS):
        inside = (number >= start) & (number < start + PRODUCT_COLUMNS)
        part = np.zeros((len(sets), PRODUCT_COLUMNS), np.float32)
        part[owners[inside], number[inside] - start] = 1
        total += part @ part.T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def forest(links, size: int) -> list[tuple[int, int]]:
    """Links that join what those before them have left apart."""
    parent = list(range(size))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def linked_blocks(banding: Bands):
    def run(table: pa.Table) -> pa.Table:
        """A forest of the links between the members of two blocks (or within one)."""
        nodes = table.column("node").to_pylist()
        order = sorted(range(len(nodes)), key=lambda i: (table.column("block")[i].as_py(), nodes[i]))
        table, nodes = table.take(order), [nodes[i] for i in order]
        least = np.frombuffer(b"".join(table.column("minima").to_pylist()), np.uint16).reshape(len(nodes), -1)
        pairs = likely_pairs(least, table.column("block").to_numpy(), banding.least_agreeing)
        kept: list[tuple[int, int]] = []
        if len(pairs):
            used, places = np.unique(pairs, return_inverse=True)
            raw = table.column("shingles")
            sets = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in used]
            pairs = places.reshape(pairs.shape)
            both = intersections(sets, pairs)
            sizes = np.array([len(s) for s in sets])
            union = sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - both
            links = pairs[100 * both >= banding.percent * union]
            kept = [(int(used[a]), int(used[b])) for a, b in forest(links.tolist(), len(used))]
        give_back()
        return pa.table({
            "u": pa.array([nodes[a] for a, _ in kept], pa.binary()), "v": pa.array([nodes[b] for _, b in kept], pa.binary()),
        })

    return run


def sketches(docs: DataFrame, banding: Bands) -> DataFrame:
    """``doc_id, text_hash, n_shingles, node, bands, minima`` per document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(frugal(sketch_batches(banding)), SKETCH)


def candidate_clusters(classes: DataFrame) -> DataFrame:
    """``node, cluster`` for classes that share a band key with another one."""
    banded = classes.select(F.explode("bands").alias("band"), "node")
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1")
    ties = banded.join(hubs.select("band", "hub"), "band").where("node != hub")
    roots = connected_components(ties.select(F.col("node").alias("u"), F.col("hub").alias("v")))
    return roots.select("node", F.col("root").alias("cluster"))


def block_pairs(placed: DataFrame) -> DataFrame:
    """``node, cluster, i, j, block``: every two blocks of a cluster, each with itself too.

    ``placed`` has ``node, cluster, n``.  Blocks are drawn by hash.
    """
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = placed.groupBy("cluster").agg(blocks.alias("blocks"))
    dealt = placed.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meetings = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return meetings.select(
        "node", "cluster", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block"
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash, root`` per document; ``root`` names the component.

    Documents are linked whose sets have a similarity of ``percent`` or more.
    """
    ship_package(docs.sparkSession)
    banding = bands_for(percent)
    sketch = stored(sketches(docs, banding), "sketches")
    # A class is known by its set; it takes its text from its smallest id, or from any text where it has none.
    classes = stored(
        sketch.where("node IS NOT NULL").groupBy("node").agg(
            F.min("doc_id").alias("representative"), F.min("text_hash").alias("text_hash"), F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"), F.first("minima").alias("minima"),
        ),
        "classes",
    )
    clusters = stored(candidate_clusters(classes), "clusters")
    candidates = clusters.join(classes.select("node", "representative", "text_hash", "n", "minima"), "node")

    with_id = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        candidates.select(F.col("representative").alias("doc_id")).distinct(), "doc_id", "left_semi"
    )
    hashed = docs.where("doc_id IS NULL").select(F.xxhash64("text").alias("text_hash"), "text")
    without_id = hashed.groupBy("text_hash").agg(F.first("text").alias("text")).join(
        candidates.where("representative IS NULL").select("text_hash"), "text_hash", "left_semi"
    )
    texts = with_id.select("text").unionByName(without_id.select("text"))
    sets = texts.select(F.lit(0).alias("doc_id"), "text").mapInArrow(frugal(set_batches), "node binary, shingles binary")
    members = stored(
        candidates.join(sets, "node").groupBy("node").agg(
            *[F.first(c).alias(c) for c in ("cluster", "n", "minima", "shingles")]
        ),
        "candidate-sets",
    )
    meetings = block_pairs(members.select("node", "cluster", "n")).join(members.select("node", "minima", "shingles"), "node")
    links = meetings.groupBy("cluster", "i", "j").applyInArrow(linked_blocks(banding), "u binary, v binary")
    roots = connected_components(links)

    rooted = classes.select("node", "representative").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("representative").alias("component_id"))
    placed_classes = rooted.join(smallest, "root").select("node", "root", "component_id")
    joined = sketch.select("doc_id", "text_hash", "n_shingles", "node").join(placed_classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        "text_hash", "root",
    )


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, all columns unchanged; repeated rows without words stay once.

    It is the component's smallest id, of several texts with that id the one of smallest hash.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_doc")
    id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")
    rows = docs.select(row, id_key, F.xxhash64("text").alias("_text_hash"))
    found = near_duplicates(docs, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    one = found.where("root IS NOT NULL").groupBy("root").agg(first).select("first.doc_id", "first.text_hash")
    kept = one.unionByName(found.where("root IS NULL").select("doc_id", "text_hash")).select(
        id_key, F.col("text_hash").alias("_text_hash")
    ).distinct()
    chosen = rows.join(kept, ["_id", "_text_hash"], "left_semi").dropDuplicates(["_id", "_text_hash"])
    return chosen.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
