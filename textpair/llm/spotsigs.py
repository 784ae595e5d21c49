"""Document fingerprints from spot signatures.

A spot signature is a common word (the anchor) with the chain of the next
content words after it, common words between them skipped.  The distinct
signatures of a text, hashed to 32 bits and sorted, are its fingerprint;
likeness of two fingerprints is the Jaccard similarity of the sets.  Menus and
lists have few anchors, so they weigh little.

Everything is a DataFrame expression: one split, two filters and one transform
per text, all linear in its length.

Edge cases: a text without a complete chain is signed by its whole word
sequence; a text without words, an empty or a null text has the empty
fingerprint; equal fingerprints have likeness 1, also empty ones; one empty
fingerprint has likeness 0.  Rows equal in id and text are one document with one
neighbour; ids that tie are ordered by the text's hash; null ids come first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpair.llm.common import let, stored

# Common words of the languages treated.
COMMON_WORDS = tuple(
    (
        "a an and are as at by for from in is it of on or that the this to was with "
        "au avec dans de des du en est et la le les par pas pour que qui sur un une "
        "als auf das dem den der die ein eine im ist mit nicht sich und von zu "
        "al con del el es las lo los no por se su una y"
    ).split()
)
NOT_WORD = "[^\\p{L}\\p{N}]+"
CHAIN = 2


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def signatures(text: Column, chain: int = CHAIN, common=COMMON_WORDS) -> Column:
    """Sorted distinct signatures of each text as ``array<int>``; never null."""

    def chains(all_words: Column) -> Column:
        parts = F.struct(
            F.filter(all_words, lambda w: ~w.isin(*common)).alias("content"),
            F.filter(
                F.transform(all_words, lambda w, i: F.when(w.isin(*common), i)), lambda i: i.isNotNull()
            ).alias("anchors"),
        )

        def signed(p: Column) -> Column:
            # The j-th anchor, at word i, has i - j content words before it.
            return F.transform(
                p["anchors"],
                lambda i, j: F.when(
                    i - j + chain <= F.size(p["content"]),
                    F.hash(F.get(all_words, i), *[F.get(p["content"], i - j + k) for k in range(chain)]),
                ),
            )

        found = F.array_sort(F.array_distinct(F.filter(let(parts, signed), lambda s: s.isNotNull())))
        whole = F.array(F.hash(F.lit(""), F.array_join(all_words, " ")))
        return F.when(F.size(all_words) == 0, F.array().cast("array<int>")).otherwise(
            let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(whole))
        )

    return let(words(F.coalesce(text, F.lit(""))), chains)


def fingerprint(signs: Column) -> Column:
    """Eight hexadecimal digits per signature."""
    return F.array_join(F.transform(signs, lambda s: F.lpad(F.hex(s.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    return F.when(a == b, 1.0).otherwise(
        let(
            F.size(F.array_intersect(a, b)),
            lambda both: both / (F.size(a) + F.size(b) - both),
        )
    )


def neighbours(docs: DataFrame) -> DataFrame:
    """``doc_id, _text_hash, _n, _prev`` for each distinct document.

    ``_prev`` has key and length of the document before it in order of id; the
    first document's is the last.  Only keys and lengths are sorted: ranges in
    parallel, then the last row of each range goes to the next one.
    """
    slim = (
        docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), F.coalesce(F.length("text"), F.lit(0)).alias("_n"))
        .groupBy("doc_id", "_text_hash").agg(F.max("_n").alias("_n"))
    )
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(
        slim.repartitionByRange(ranges, "doc_id", "_text_hash").withColumn("_range", F.spark_partition_id()),
        "document-order",
    )
    row = F.struct("doc_id", "_text_hash", "_n")
    lasts = placed.groupBy("_range").agg(F.max(row).alias("_last"))
    across = Window.orderBy("_range")
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = lasts.select(
        "_range", F.coalesce(F.lag("_last").over(across), F.last("_last").over(whole)).alias("_carried")
    )
    inside = Window.partitionBy("_range").orderBy("doc_id", "_text_hash")
    return (
        placed.withColumn("_prev", F.lag(row).over(inside)).join(lasts, "_range")
        .select("doc_id", "_text_hash", "_n", F.coalesce("_prev", "_carried").alias("_prev"))
    )


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and two likenesses.

    The edited text is the text with its last half replaced by the start of the
    next document.  Texts are shuffled once, by key; the next document's start
    and signatures are shuffled to where they are needed.
    """
    # Null ids meet through a key that is never null.  Both joins below read the
    # same three columns, so the texts are shuffled for the first and reused.
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"), F.xxhash64("text").alias("_text_hash"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = neighbours(docs).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"), "_text_hash",
        F.coalesce(F.col("_prev.doc_id").cast("string"), F.lit("")).alias("_to_key"),
        F.col("_prev._text_hash").alias("_to_hash"), F.floor(F.col("_prev._n") / 2).cast("int").alias("_wanted"),
    )
    starts = (
        keyed.join(order, ["_key", "_text_hash"])
        .select(
            F.col("_to_key").alias("_key"), F.col("_to_hash").alias("_text_hash"),
            F.substring("text", F.lit(1), F.col("_wanted")).alias("_start"), signatures(F.col("text")).alias("_next_signs"),
        )
        .groupBy("_key", "_text_hash").agg(F.first("_start").alias("_start"), F.first("_next_signs").alias("_next_signs"))
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), "_start")
    both = keyed.join(starts, ["_key", "_text_hash"]).select(
        F.nullif("_key", F.lit("")).cast("bigint").alias("doc_id"), n.cast("bigint").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"),
        F.struct(
            signatures(F.col("text")).alias("own"), signatures(edited).alias("edited"),
            F.col("_next_signs").alias("next"),
        ).alias("_signs"),
    )
    return both.select(
        "doc_id", "n_chars", "edited_sha256",
        F.inline(
            F.transform(
                F.array("_signs"),
                lambda s: F.struct(
                    fingerprint(s["own"]).alias("fingerprint"), fingerprint(s["edited"]).alias("edited_fingerprint"),
                    likeness(s["own"], s["edited"]).alias("near_edited"), likeness(s["own"], s["next"]).alias("near_next"),
                ),
            )
        ),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs of different fingerprints with at least the given likeness, and membership.

    Returns ``(pairs, members)``: ``pairs`` has ``a, b, likeness`` between class
    representatives (smallest id of an equal fingerprint), ``members`` has
    ``doc_id, representative``.  Sets are partitioned by length so that only equal
    or adjacent partitions can be alike.  Signatures are taken rarest first; two
    alike sets share one of their first ``n - ceil(threshold * n) + 1``, so only
    those are joined, and candidates whose lengths already bound the likeness
    below the threshold are dropped before the sets are compared.  Rows without
    an id and texts without words are members of no class.
    """
    signed = docs.select("doc_id", signatures(F.col("text")).alias("signs")).where(
        "doc_id IS NOT NULL AND size(signs) > 0"
    )
    members = signed.groupBy("signs").agg(F.min("doc_id").alias("representative"))
    sets = stored(members, "signature-sets")
    tokens = sets.select("representative", F.size("signs").alias("n"), F.explode("signs").alias("sign"))
    frequency = tokens.groupBy("sign").agg(F.count("*").alias("documents"))
    rank = Window.partitionBy("representative").orderBy("documents", "sign")
    first = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    prefixes = (
        tokens.join(frequency, "sign").withColumn("place", F.row_number().over(rank)).where(F.col("place") <= first)
        .withColumn("length_class", F.floor(F.log("n") / -math.log(threshold) + 1e-9))
        .select("representative", "n", "sign", "length_class")
    )
    left = prefixes.select(F.col("representative").alias("a"), F.col("n").alias("n_a"), "sign",
                           F.explode(F.array("length_class", F.col("length_class") + 1)).alias("length_class"))
    right = prefixes.select(F.col("representative").alias("b"), F.col("n").alias("n_b"), "sign", "length_class")
    fits = (F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (
        (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    )
    candidates = left.join(right, ["sign", "length_class"]).where(fits).select("a", "b").distinct()
    scored = (
        candidates.join(sets.select(F.col("representative").alias("a"), F.col("signs").alias("signs_a")), "a")
        .join(sets.select(F.col("representative").alias("b"), F.col("signs").alias("signs_b")), "b")
        .select("a", "b", likeness(F.col("signs_a"), F.col("signs_b")).alias("likeness"))
    )
    pairs = scored.where(F.col("likeness") >= threshold)
    return pairs, signed.join(sets, "signs").select("doc_id", "representative")
