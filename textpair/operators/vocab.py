"""A word vocabulary built from the corpus, and token ids.

A vocabulary of a checked size goes to every task, which looks its tokens up in
place: rows are neither taken apart nor shuffled.  One that is larger is
joined: rows get a number, their tokens are looked up, and the ids are gathered
per number, so repeated keys stay separate rows.  The few words that make up
most of a corpus are then dealt over ``SALTS`` copies of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpair.functions.rouge import rouge_tokens
from textpair.operators.sampling import first_rows

# Special tokens and their ids, vocabulary size, length limits,
# the label value that training ignores.
SPECIAL = {"<pad>": 0, "</s>": 1, "<unk>": 2}
PAD, EOS, UNK = 0, 1, 2
VOCAB_SIZE = 32_000
MAX_INPUT = 512
MAX_LABEL = 30
IGNORED = -100

# Copies of the vocabulary that share the rows of a frequent token.
SALTS = 8
# Entries and bytes of the largest vocabulary that every task gets whole.
MOST_TOKENS = 500_000
MOST_BYTES = 32 << 20


def build_vocab(df: DataFrame, cols: Sequence[str], size: int = VOCAB_SIZE) -> DataFrame:
    """``(token, id)``: special tokens, then words by falling count."""
    tokens = df.select(F.explode(F.concat(*[rouge_tokens(c) for c in cols])).alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    order = [F.desc("_n"), F.col("token")]
    top = first_rows(counts, order, size - len(SPECIAL))
    # At most ``size`` rows are left, so one window may number them.
    ranked = top.select(
        "token",
        (F.row_number().over(Window.orderBy(*order)) + (len(SPECIAL) - 1)).cast("int").alias("id"),
    )
    special = df.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(t).alias("token"), F.lit(i).alias("id")) for t, i in SPECIAL.items()]))
    )
    return special.unionByName(ranked)


def _small(vocab: DataFrame) -> tuple[pa.Array, pa.Array] | None:
    """Tokens and ids of a vocabulary within the limits, else nothing: its size is counted first."""
    size = vocab.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("bytes")).first()
    if size["n"] > MOST_TOKENS or size["bytes"] > MOST_BYTES:
        return None
    rows = vocab.select("token", "id").collect()
    return pa.array([r["token"] for r in rows], pa.string()), pa.array([r["id"] for r in rows], pa.int32())


def _regrouped(batch: pa.Array, values: pa.Array, keep: np.ndarray | None = None) -> pa.Array:
    """Flat values in the lists that ``batch`` has, those not kept left out; a null list becomes empty."""
    sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if keep is not None:
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        values = values.filter(pa.array(keep))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def _ids_of(entries, unknown: int):
    """A column function: arrays of tokens to arrays of ids."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, numbers = entries.value
        for batch in batches:
            found = numbers.take(pc.index_in(batch.flatten(), value_set=tokens))
            yield _regrouped(batch, pc.fill_null(found, unknown))

    return ids


def _text_of(entries):
    """A column function: arrays of ids to their tokens, joined by spaces; unknown ids are left out."""
    @F.arrow_udf(T.StringType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, numbers = entries.value
        for batch in batches:
            found = tokens.take(pc.index_in(batch.flatten(), value_set=numbers))
            yield pc.binary_join(_regrouped(batch, found, pc.is_valid(found).to_numpy(zero_copy_only=False)), " ")

    return text


def _looked_up(rows: DataFrame, items: Column, vocab: DataFrame, on: str, value: Column) -> DataFrame:
    """The first column of ``rows`` and ``_items``: ``value`` of every item's vocabulary entry, in order.

    ``items`` is an array of structs with ``list``, ``pos`` and the column
    ``on``.  Rows without items stay, with an empty array.
    """
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    single = numbered.select(
        "_row", F.struct(rows.columns[0]).alias("_kept"), F.explode_outer(items).alias("_item"),
    ).withColumn("_salt", (F.col("_row") % SALTS).cast("int")).withColumn(on, F.col(f"_item.{on}"))
    copies = vocab.select("token", "id").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = single.join(copies, [on, "_salt"], "left")
    entry = F.when(F.col("_item").isNotNull(), F.struct("_item.list", "_item.pos", value.alias("value")))
    gathered = found.groupBy("_row").agg(
        F.first("_kept").alias("_kept"), F.array_sort(F.collect_list(entry)).alias("_items")
    )
    return gathered.select("_kept.*", "_items")


def _items(tokens: Column, number: int, name: str) -> Column:
    whole = F.coalesce(tokens, F.array().cast("array<string>" if name == "token" else "array<int>"))
    return F.transform(whole, lambda t, i: F.struct(F.lit(number).alias("list"), i.alias("pos"), t.alias(name)))


def _values(number: int) -> Column:
    return F.transform(F.filter("_items", lambda x: x["list"] == number), lambda x: x["value"])


def encode_tokens(
    df: DataFrame,
    vocab: DataFrame,
    input_col: str = "input_text",
    label_col: str = "short_query",
    key: str = "product_id",
    max_input: int = MAX_INPUT,
    max_label: int = MAX_LABEL,
) -> DataFrame:
    """``(key, input_ids, attention_mask, labels)``, one row per row of ``df``.

    Inputs and labels are cut so that, with the closing token, they have at
    most ``max_input`` and ``max_label`` ids.  Only the tokens that survive
    the cut are looked up.
    """
    cut_input = F.slice(rouge_tokens(input_col), 1, max_input - 1)
    cut_label = F.slice(rouge_tokens(label_col), 1, max_label - 1)
    small = _small(vocab)
    if small is not None:
        ids = _ids_of(df.sparkSession.sparkContext.broadcast(small), UNK)
        closed = df.select(
            key,
            F.array_append(ids(cut_input), F.lit(EOS)).alias("input_ids"),
            F.array_append(ids(cut_label), F.lit(EOS)).alias("labels"),
        )
        return closed.select(
            key, "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"), "labels"
        )
    rows = df.select(key, F.concat(_items(cut_input, 0, "token"), _items(cut_label, 1, "token")).alias("_tokens"))
    found = _looked_up(rows, F.col("_tokens"), vocab, "token", F.coalesce("id", F.lit(UNK)))
    closed = found.select(
        key,
        F.array_append(_values(0), F.lit(EOS)).alias("input_ids"),
        F.array_append(_values(1), F.lit(EOS)).alias("labels"),
    )
    return closed.select(
        key, "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"), "labels"
    )


def decode_tokens(
    df: DataFrame, vocab: DataFrame, ids_col: str = "labels", key: str = "product_id", out: str = "text"
) -> DataFrame:
    """``(key, out)``: ids back to text, special and ignored ids left out; no ids give an empty text."""
    cleaned = F.transform(ids_col, lambda i: F.when(i == IGNORED, PAD).otherwise(i))
    kept = F.filter(cleaned, lambda i: ~i.isin(*SPECIAL.values()))
    small = _small(vocab)
    if small is not None:
        return df.select(key, _text_of(df.sparkSession.sparkContext.broadcast(small))(kept).alias(out))
    rows = df.select(key, _items(kept, 0, "id").alias("_ids"))
    found = _looked_up(rows, F.col("_ids"), vocab, "id", F.col("token"))
    words = F.filter(_values(0), lambda t: t.isNotNull())
    return found.select(key, F.array_join(words, " ").alias(out))
