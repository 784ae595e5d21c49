"""ROUGE-1, ROUGE-2, ROUGE-L and ROUGE-Lsum as column functions.

``rouge_n`` has two plans.  The row-local one is built from Spark functions
and suits short texts; ``rouge_n_exploded`` counts n-grams with two
aggregations and suits pairs whose texts are too long for one row's quadratic
counting.  ``rouge_scores`` sends a pair through Arrow once and returns the
integer counts all four scores need; its cost is linear in the words for the
n-gram part and bit-parallel for the subsequence part, so whole documents are
scored, never prefixes.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpair.functions.once import bound, with_column_once
from textpair.functions.stem import stem_token
from textpair.functions.text import _col

SCORE_COLUMNS = ["rouge1", "rouge2", "rougeL", "rougeLsum"]

# Memory of the subsequence step: masks kept of a text, and the fewest bit rows of
# a block, so that short lines are walked without making rows again.
KEPT_MASKS = 512
LEAST_BLOCK = 1024
# Characters (n times, for n-grams) whose counts a task of ``rouge_n_exploded`` holds.
CHARS_PER_TASK = 8_000_000

_COUNT_NAMES = ["n_pred", "n_ref", "overlap1", "overlap2", "lcs", "union_lcs"]
_COUNTS_TYPE = T.StructType([T.StructField(name, T.IntegerType()) for name in _COUNT_NAMES])


def rouge_spaced(c: Column | str) -> Column:
    """The tokens of ``rouge_tokens`` as text: one space between tokens, perhaps one at either end."""
    return F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]+", " ")


def rouge_tokens(c: Column | str) -> Column:
    """Lower-case runs of ``a-z0-9``; every other character separates tokens."""
    return F.array_remove(F.split(rouge_spaced(c), " "), "")


def rouge_lines(c: Column | str) -> Column:
    """The tokens as text: one space between tokens, line breaks kept."""
    return F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9\n]+", " ")


# --------------------------------------------------------------------------
# precision, recall, F


def overlap_scores(overlap: Column, n_pred: Column, n_ref: Column) -> Column:
    """``struct<p, r, f>`` from an overlap count and the two lengths."""
    p = overlap / F.greatest(n_pred, F.lit(1))
    r = overlap / F.greatest(n_ref, F.lit(1))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return F.struct(p.alias("p"), r.alias("r"), f.alias("f"))


def percent(f: Column) -> Column:
    """Fraction to percent with two decimals, ties to even."""
    return F.bround(F.coalesce(f, F.lit(0.0)) * 100, 2)


# --------------------------------------------------------------------------
# n-gram overlap


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of a token array, each joined by a space."""
    if n == 1:
        return tokens

    def grams(words: Column) -> Column:
        size = F.size(words)
        joined = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(size >= n, joined).otherwise(F.array().cast("array<string>"))

    return bound(tokens, grams)


def clipped_overlap(p: Column, r: Column) -> Column:
    """Size of the multiset intersection of two string arrays.

    Both sides' entries are sorted together and counted in one pass, run by run.
    """
    def tagged(items: Column, side: int) -> Column:
        return F.transform(items, lambda g: F.struct(g.alias("gram"), F.lit(side).alias("side")))

    empty = F.struct(
        F.lit("").alias("gram"), F.lit(0).alias("p"), F.lit(0).alias("r"), F.lit(0).alias("total")
    )

    def step(run: Column, item: Column) -> Column:
        same = run["gram"] == item["gram"]
        on_left, on_right = (F.when(item["side"] == side, 1).otherwise(0) for side in (0, 1))
        return F.struct(
            item["gram"].alias("gram"),
            (F.when(same, run["p"]).otherwise(0) + on_left).alias("p"),
            (F.when(same, run["r"]).otherwise(0) + on_right).alias("r"),
            (run["total"] + F.when(same, 0).otherwise(F.least(run["p"], run["r"]))).alias("total"),
        )

    both = F.array_sort(F.concat(tagged(p, 0), tagged(r, 1)))
    return F.aggregate(both, empty, step, lambda run: run["total"] + F.least(run["p"], run["r"]))


def rouge_n(pred: Column | str, ref: Column | str, n: int) -> Column:
    """Clipped n-gram overlap, ``struct<p, r, f>``; row-local plan, sorted once per pair."""
    grams = F.struct(ngrams(rouge_tokens(pred), n).alias("p"), ngrams(rouge_tokens(ref), n).alias("r"))
    return bound(
        grams, lambda g: overlap_scores(clipped_overlap(g["p"], g["r"]), F.size(g["p"]), F.size(g["r"]))
    )


def rouge_n_exploded(
    df: DataFrame, key: Sequence[str], pred: str, ref: str, n: int, out: str = "score"
) -> DataFrame:
    """Clipped n-gram overlap for long texts: one row per ``key`` with ``out``.

    ``key`` must identify a pair.  The pairs are distributed by key once, as
    texts; both sides' n-grams then go through the same two aggregations, which
    need no further shuffle and no join.  A first pass measures the texts: a task
    groups the n-grams of about ``CHARS_PER_TASK`` characters, however many there
    are in all, where an adaptive plan would go by compressed bytes.
    """
    key = list(key)
    texts = df.select(*key, pred, ref)
    length = F.sum(F.length(F.coalesce(pred, F.lit(""))) + F.length(F.coalesce(ref, F.lit(""))))
    chars = texts.agg(length.alias("chars")).first()["chars"] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-chars * n // CHARS_PER_TASK))
    pairs = texts.repartition(tasks, *key).select(
        *key,
        ngrams(rouge_tokens(pred), n).alias("_p"),
        ngrams(rouge_tokens(ref), n).alias("_r"),
    )
    grams = pairs.select(
        *key,
        F.explode(
            F.concat(
                F.transform("_p", lambda g: F.struct(g.alias("gram"), F.lit(1).alias("p"), F.lit(0).alias("r"))),
                F.transform("_r", lambda g: F.struct(g.alias("gram"), F.lit(0).alias("p"), F.lit(1).alias("r"))),
                # keeps pairs without any n-gram in the result
                F.array(F.struct(F.lit(None).cast("string").alias("gram"), F.lit(0).alias("p"), F.lit(0).alias("r"))),
            )
        ).alias("g"),
    )
    counted = grams.groupBy(*key, F.col("g.gram").alias("gram")).agg(
        F.sum("g.p").alias("p"), F.sum("g.r").alias("r")
    )
    totals = counted.groupBy(*key).agg(
        F.sum(F.least("p", "r")).alias("_o"), F.sum("p").alias("_np"), F.sum("r").alias("_nr")
    )
    return totals.select(*key, overlap_scores(F.col("_o"), F.col("_np"), F.col("_nr")).alias(out))


# --------------------------------------------------------------------------
# longest common subsequence


class _RareMasks:
    """Masks of a long text: those of the most frequent tokens are kept, others made when asked for.

    A mask is as long as the text, so one for every distinct token would need
    quadratic memory; a token that is not kept has few bits to set.
    """

    def __init__(self, tokens: Sequence[str]) -> None:
        self._places: dict[str, list[int]] = {}
        for j, token in enumerate(tokens):
            self._places.setdefault(token, []).append(j)
        frequent = heapq.nlargest(KEPT_MASKS, self._places, key=lambda token: len(self._places[token]))
        self._kept = {token: self._mask(token) for token in frequent}

    def _mask(self, token: str) -> int:
        places = self._places[token]
        bits = bytearray((places[-1] >> 3) + 1)
        for j in places:
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    def get(self, token: str, default: int) -> int:
        mask = self._kept.get(token)
        if mask is not None:
            return mask
        return self._mask(token) if token in self._places else default

    def __iter__(self) -> Iterator[str]:
        return iter(self._places)


def _positions(tokens: Sequence[str]) -> dict[str, int] | _RareMasks:
    """Token -> integer whose bit j is set where the token stands at j."""
    if len(tokens) > KEPT_MASKS:
        return _RareMasks(tokens)
    masks: dict[str, int] = {}
    for j, token in enumerate(tokens):
        masks[token] = masks.get(token, 0) | (1 << j)
    return masks


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``b``."""
    if not a or not b:
        return 0
    masks = _positions(b)
    full = (1 << len(b)) - 1
    row = full
    for token in a:
        hit = row & masks.get(token, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _bit_rows(
    row: int, tokens: Sequence[str], masks: dict[str, int] | _RareMasks, full: int
) -> list[int]:
    """``row`` and the bit rows behind it, one for each token, within the columns of ``full``."""
    rows = [row]
    for token in tokens:
        hit = row & masks.get(token, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows


def _matched(ref: Sequence[str], cand: Sequence[str], masks: dict[str, int] | _RareMasks) -> set[int]:
    """Positions of ``ref`` on the longest common subsequence with ``cand``.

    Where several subsequences are longest, the walk from the end steps left
    only when that keeps strictly more than stepping up, because the choice
    decides which reference positions count.

    The walk needs every bit row.  Of a long line only the first row of each
    block of about ``sqrt(len(ref))`` rows is kept; a block's rows are made
    again, as far right as the walk can still go, when the walk enters it.
    """
    block = max(LEAST_BLOCK, math.isqrt(len(ref)))
    starts: list[int] = []
    rows = [(1 << len(cand)) - 1]
    for base in range(0, len(ref), block):
        starts.append(rows[-1])
        rows = _bit_rows(rows[-1], ref[base : base + block], masks, starts[0])

    def table(i: int, j: int) -> int:
        return j - (rows[i - base] & ((1 << j) - 1)).bit_count()

    found = set()
    i, j = len(ref), len(cand)
    here = table(i, j)
    while i and j and here:
        if i == base:
            starts.pop()
            base -= block
            rest = (1 << j) - 1
            rows = _bit_rows(starts[-1] & rest, ref[base:i], masks, rest)
        if ref[i - 1] == cand[j - 1]:
            found.add(i - 1)
            i, j, here = i - 1, j - 1, here - 1
            continue
        above = table(i - 1, j)
        if above < here:
            j -= 1
        else:
            i, here = i - 1, above
    return found


def union_lcs_hits(ref_lines: Sequence[Sequence[str]], pred_lines: Sequence[Sequence[str]]) -> int:
    """Matches of all reference lines against the union of prediction lines.

    A token counts at most as often as it occurs in the prediction.
    """
    distinct = {tuple(line): None for line in pred_lines if line}
    candidates = [(line, _positions(line)) for line in distinct]
    available = Counter(token for line in pred_lines for token in line)
    used: Counter[str] = Counter()
    for ref in ref_lines:
        vocabulary = set(ref)
        union: set[int] = set()
        for line, masks in candidates:
            if not vocabulary.isdisjoint(masks):
                union |= _matched(ref, line, masks)
        used.update(ref[i] for i in union)
    return sum(min(n, available[token]) for token, n in used.items())


def pair_counts(pred: str, ref: str, stem: bool = False) -> tuple[int, int, int, int, int, int]:
    """The integer counts behind the four scores, from two ``rouge_lines`` texts."""
    pred_lines = [line.split() for line in pred.split("\n")]
    ref_lines = [line.split() for line in ref.split("\n")]
    if stem:
        pred_lines = [[stem_token(t) for t in line] for line in pred_lines]
        ref_lines = [[stem_token(t) for t in line] for line in ref_lines]
    p = [t for line in pred_lines for t in line]
    r = [t for line in ref_lines for t in line]
    if not p or not r:
        return len(p), len(r), 0, 0, 0, 0
    unigrams = (Counter(p) & Counter(r)).total()
    if not unigrams:
        return len(p), len(r), 0, 0, 0, 0
    bigrams = (Counter(zip(p, p[1:])) & Counter(zip(r, r[1:]))).total()
    lcs = lcs_length(p, r)
    if len(pred_lines) == 1 and len(ref_lines) == 1:
        union = lcs
    else:
        union = union_lcs_hits(ref_lines, pred_lines)
    return len(p), len(r), unigrams, bigrams, lcs, union


def _count_batch(preds: pd.Series, refs: pd.Series, stem: bool) -> pd.DataFrame:
    seen: dict[tuple[str, str], tuple] = {}
    rows = []
    for pair in zip(preds, refs):
        counts = seen.get(pair)
        if counts is None:
            counts = seen[pair] = pair_counts(*pair, stem=stem)
        rows.append(counts)
    return pd.DataFrame(rows, columns=_COUNT_NAMES, dtype="int32")


@F.pandas_udf(_COUNTS_TYPE)
def _counts_plain(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    return _count_batch(pred, ref, stem=False)


@F.pandas_udf(_COUNTS_TYPE)
def _counts_stemmed(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    return _count_batch(pred, ref, stem=True)


def rouge_counts(pred: Column | str, ref: Column | str, stem: bool = False) -> Column:
    """Lengths and overlaps of a pair, ``struct`` of integers."""
    udf = _counts_stemmed if stem else _counts_plain
    return udf(rouge_lines(pred), rouge_lines(ref))


def rouge_l(pred: Column | str, ref: Column | str, stem: bool = False) -> Column:
    """Longest-common-subsequence ``struct<p, r, f>``."""
    c = rouge_counts(pred, ref, stem)
    return overlap_scores(c["lcs"], c["n_pred"], c["n_ref"])


def rouge_lsum(pred: Column | str, ref: Column | str, stem: bool = False) -> Column:
    """Union subsequence over lines, ``struct<p, r, f>``; lines split at newlines."""
    c = rouge_counts(pred, ref, stem)
    return overlap_scores(c["union_lcs"], c["n_pred"], c["n_ref"])


def _f_from_counts(c: Column) -> dict[str, Column]:
    n_pred, n_ref = c["n_pred"], c["n_ref"]
    one = F.lit(1)
    zero = F.lit(0)
    return {
        "rouge1": overlap_scores(c["overlap1"], n_pred, n_ref)["f"],
        "rouge2": overlap_scores(
            c["overlap2"], F.greatest(n_pred - one, zero), F.greatest(n_ref - one, zero)
        )["f"],
        "rougeL": overlap_scores(c["lcs"], n_pred, n_ref)["f"],
        "rougeLsum": overlap_scores(c["union_lcs"], n_pred, n_ref)["f"],
    }


def with_rouge_f(df: DataFrame, pred: Column | str, ref: Column | str, stem: bool = False) -> DataFrame:
    """Add the four F measures as fractions, scoring each row once."""
    counted = with_column_once(df, "_counts", rouge_counts(pred, ref, stem))
    return counted.withColumns(_f_from_counts(F.col("_counts"))).drop("_counts")


def with_rouge_scores(df: DataFrame, pred: Column | str, ref: Column | str, stem: bool = False) -> DataFrame:
    """Add the four scores in percent with two decimals.

    A missing or empty text scores 0; any other failure is raised.
    """
    counted = with_column_once(df, "_counts", rouge_counts(pred, ref, stem))
    scores = {name: percent(f) for name, f in _f_from_counts(F.col("_counts")).items()}
    return counted.withColumns(scores).drop("_counts")
