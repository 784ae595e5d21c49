"""Mix document sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded shuffle, gone through at
most ``MAX_PASSES`` times.  A document's virtual finish time is the number of
its source's words served up to its end, divided by the source's target.  The
mix is the documents of all sources in order of finish time, truncated where
the total budget is used up.  At virtual time 1 every source has been served
its target; the document in service at that moment is cut there, so a source's
words miss its target by less than one word.

Edge cases: a null or empty text has size 0 and is never taken; null is a
source of its own, last in order; a source without words has target 0; repeated
rows are separate documents; an empty table gives an empty mix.  Columns of the
input beside ``doc_id``, ``text`` and ``source`` pass through ``mix``
unchanged, whatever their names.

The order of rows is by hash, so reruns agree.  Only sums per source and hash
slot, the sources themselves (few, as each has a weight of its own) and one cut
value are global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpair.llm.common import running_total, slot_totals, stored, text_key

# Fixed by contract: weights in turn over the sources in code-point order, the
# share of all words to take, and how often a word may be taken.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_PASSES = 2
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = "[\\x20\\x09-\\x0D]+"
FINISH_SLOTS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def queue_columns(docs: DataFrame, seed: int = 0) -> list[Column]:
    """Queue key, position hash and size of each document."""
    return [
        text_key(docs["source"]).alias("_queue"),
        F.xxhash64(docs["doc_id"], docs["text"], F.lit(seed)).alias("_hash"),
        n_words(docs["text"]).alias("_size"),
    ]


def targets(sizes: DataFrame) -> DataFrame:
    """``_queue, _source_size, _target`` from any table of ``_queue, _total`` sums.

    Targets are proportional to the weights; those above ``MAX_PASSES`` times
    their source's size stop there, and what is left is shared again.  The
    result is the level at which min(cap, level * weight) adds up to the budget:
    sorted by cap / weight, the first k sources are capped, where k is the
    first for which the level of the others does not reach the next cap.
    """
    sources = sizes.groupBy("_queue").agg(F.sum("_total").alias("_source_size"))
    # '' (a null source) sorts last: the flag comes before the name.
    by_name = Window.orderBy((F.col("_queue") == ""), "_queue")
    everything = Window.partitionBy(F.lit(0))
    weighted = sources.withColumn(
        "_weight",
        F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1),
    ).withColumn("_cap", F.col("_source_size") * MAX_PASSES)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "_queue")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("_source_size").over(everything) * BUDGET
    level = (budget - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))) / F.sum("_weight").over(later)
    leveled = weighted.withColumn("_level", level)
    fits = F.col("_level") * F.col("_weight") <= F.col("_cap")
    chosen = F.min(F.when(fits, F.struct(F.col("_cap") / F.col("_weight"), "_queue", "_level"))).over(everything)
    final = F.coalesce(chosen["_level"] * F.col("_weight"), F.col("_cap").cast("double"))
    return leveled.select(
        "_queue", "_source_size", F.least(final, F.col("_cap").cast("double")).alias("_target")
    )


def schedule(rows: DataFrame, totals: DataFrame, goals: DataFrame, ties: list[str]) -> DataFrame:
    """Add ``_source_size, _target, _services`` to rows with the queue columns.

    ``_services`` has one entry per pass over the source: its number, the words
    served up to the source's target, and the virtual finish time.
    """
    queued = running_total(rows, "_queue", "_hash", "_size", ties, "_before", totals).join(goals, "_queue")

    def service(turn: int) -> Column:
        start = F.col("_before") + F.lit(turn) * F.col("_source_size")
        left = F.floor("_target") - start
        served = F.when(left > 0, F.least(left, F.col("_size"))).otherwise(F.col("_size"))
        return F.struct(
            F.lit(turn).alias("turn"), served.alias("words"),
            F.try_divide(start + served, F.col("_target")).alias("finish"),
        )

    return queued.withColumn("_services", F.array(*[service(t) for t in range(MAX_PASSES)])).drop("_before")


def budget_cut(scheduled: DataFrame, goals: DataFrame) -> float:
    """The finish time at which the total budget is used up: one number.

    Words are summed per slot of finish time; inside the slot that crosses the
    budget, they are summed in order.
    """
    items = scheduled.select(F.explode("_services").alias("s")).select("s.*").where("words > 0 AND finish IS NOT NULL")
    slots = items.withColumn("slot", F.floor(F.col("finish") * FINISH_SLOTS)).groupBy("slot", "finish").agg(
        F.sum("words").alias("words")
    )
    per_slot = slots.groupBy("slot").agg(F.sum("words").alias("words"))
    so_far = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_slot.withColumn("base", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
    budget = goals.agg(F.sum(F.floor("_target"))).first()[0] or 0
    edge = bases.where((F.col("base") < budget) & (F.col("base") + F.col("words") >= budget)).first()
    if edge is None:
        return float("inf")
    inside = Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, 0)
    row = (
        slots.where(F.col("slot") == edge["slot"])
        .withColumn("total", F.lit(edge["base"]) + F.sum("words").over(inside))
        .where(F.col("total") <= budget)
        .agg(F.max("finish")).first()
    )
    return row[0] if row[0] is not None else edge["slot"] / FINISH_SLOTS


def shares(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every document."""
    rows = stored(docs.select("doc_id", "source", *queue_columns(docs, seed)), "mix-sizes")
    totals = stored(slot_totals(rows, "_queue", "_hash", "_size"), "mix-slots")
    goals = stored(targets(totals), "mix-targets")
    scheduled = stored(schedule(rows, totals, goals, ["doc_id", "_size"]), "mix-schedule")
    cut = budget_cut(scheduled, goals)
    taken = F.aggregate(
        F.filter("_services", lambda s: s["finish"] <= cut), F.lit(0).cast("bigint"),
        lambda total, s: total + s["words"],
    )
    return scheduled.select(
        "doc_id", "source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), taken.alias("taken"),
    )


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words, joined by single spaces."""
    return F.array_join(F.slice(F.filter(F.split(text, SPACES), lambda w: w != ""), 1, n.cast("int")), " ")


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed documents in order of virtual finish time.

    Columns of ``docs``; a document taken twice is there twice, one that its
    source's target cuts has its first words only (and their length in
    ``n_chars``, where that column exists).
    """
    slim = stored(docs.select("doc_id", *queue_columns(docs, seed)), "mix-sizes")
    totals = stored(slot_totals(slim, "_queue", "_hash", "_size"), "mix-slots")
    goals = stored(targets(totals), "mix-targets")
    cut = budget_cut(schedule(slim, totals, goals, ["doc_id", "_size"]), goals)

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), *queue_columns(docs, seed))
    served = (
        schedule(rows.withColumn("_id", F.col("_doc.doc_id")), totals, goals, ["_id", "_size"])
        .withColumn("_service", F.explode("_services"))
        .where((F.col("_service.finish") <= cut) & (F.col("_service.words") > 0))
    )
    text = F.when(
        F.col("_service.words") < F.col("_size"), first_words(F.col("_doc.text"), F.col("_service.words"))
    ).otherwise(F.col("_doc.text"))
    ordered = served.select("_doc", text.alias("_text"), F.col("_service.finish").alias("_finish"), "_hash", "_id")
    ordered = ordered.orderBy("_finish", "_hash", "_id")
    changed = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    return ordered.select(*[changed.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
