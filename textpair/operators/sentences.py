"""Sentence ends learned from the corpus: abbreviations, initials, ordinals, sentence starters.

After Kiss and Strunk (2006): a word is an abbreviation where a period behind it
is far more likely than behind words in general, the more so the shorter it is and
the less it is seen without one; a word starts sentences where it follows sentence
ends far more often than elsewhere.  Both are counts per word and one formula,
counted in Spark with partial sums; what is learned are two sets of words of a
documented size, which the splitting rule holds as literals, so that it stays
a column expression without a join.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpair.functions.once import bound
from textpair.functions.text import SPACE, WORD, _col, strip_text, words

# Fixed values from the paper: the likelihood of a period after an abbreviation, least scores.
LIKELY = 0.99
ABBREVIATION_SCORE = 0.3
STARTER_SCORE = 30.0
# Words of each kind that are kept, highest scores first.
MOST_WORDS = 10_000

_CANDIDATE = r"^[\p{L}.-]*\p{L}[\p{L}.-]*$"


@dataclass(frozen=True)
class SentenceEnds:
    """What was learned: lower-case abbreviations without their last period, and words that start sentences."""

    abbreviations: Collection[str] = field(default_factory=tuple)
    starters: Collection[str] = field(default_factory=tuple)


def core(token: Column) -> Column:
    """A word in lower case without the marks around it; periods behind it stay."""
    return F.lower(F.regexp_replace(F.regexp_replace(token, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}.]+$", ""))


def has_period(word: Column) -> Column:
    """Whether exactly one period ends the word."""
    return word.rlike(r"[^.]\.$")


def base(word: Column) -> Column:
    return F.regexp_replace(word, r"\.+$", "")


def abbreviation_scores(df: DataFrame, column: str) -> DataFrame:
    """``(word, n_period, n_plain, score)`` of every word that was seen with a period behind it."""
    tokens = df.select(F.explode(words(column)).alias("_token")).select(core(F.col("_token")).alias("_core"))
    seen = tokens.select(base(F.col("_core")).alias("word"), has_period(F.col("_core")).alias("_period"))
    counts = seen.groupBy("word").agg(
        F.count_if("_period").alias("n_period"), F.count_if(~F.col("_period")).alias("n_plain")
    )
    totals = counts.agg(F.sum("n_period").alias("_periods"), F.sum(F.col("n_period") + F.col("n_plain")).alias("_n"))
    rows = counts.where((F.col("n_period") > 0) & F.col("word").rlike(_CANDIDATE)).crossJoin(F.broadcast(totals))

    p = F.col("_periods") / F.col("_n")
    likelihood = F.col("n_period") * F.ln(F.lit(LIKELY) / p) + F.col("n_plain") * F.ln(F.lit(1 - LIKELY) / (1 - p))
    dots = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - dots
    weight = F.exp(-letters) * (dots + 1) * F.pow(letters, -F.col("n_plain"))
    # Where every word ends in a period there is nothing to compare with.
    score = F.when(p < 1, 2 * likelihood * weight).otherwise(F.lit(0.0))
    return rows.select("word", "n_period", "n_plain", score.alias("score"))


def starter_scores(df: DataFrame, column: str, abbreviations: Collection[str]) -> DataFrame:
    """``(word, n, n_start, score)``: how much more often than by chance a word follows a sentence end."""
    listed = words(column)
    pairs = bound(listed, lambda w: F.transform(
        w, lambda t, i: F.struct(t.alias("token"), F.when(i > 0, F.element_at(w, i)).alias("before"))
    ))
    seen = df.select(F.explode(pairs).alias("_p")).select(
        base(core(F.col("_p.token"))).alias("word"), F.coalesce(_ends(F.col("_p.before"), abbreviations), F.lit(False)).alias("_start")
    )
    counts = seen.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("_start").alias("n_start"))
    totals = counts.agg(F.sum("n").alias("_n"), F.sum("n_start").alias("_starts"))
    rows = counts.where((F.col("n_start") > 0) & F.col("word").rlike(r"^\p{L}")).crossJoin(F.broadcast(totals))
    a, b, n, both = F.col("_starts"), F.col("n"), F.col("_n"), F.col("n_start")

    def cell(seen: Column, of_row: Column, of_column: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen * n / (of_row.cast("double") * of_column))).otherwise(F.lit(0.0))

    score = 2 * (cell(both, a, b) + cell(a - both, a, n - b) + cell(b - both, n - a, b) + cell(n - a - b + both, n - a, n - b))
    more = both.cast("double") * n > a.cast("double") * b
    return rows.where(more).select("word", "n", "n_start", score.alias("score"))


def _ends(token: Column, abbreviations: Collection[str]) -> Column:
    """Whether a word ends a sentence, as far as the word alone tells."""
    word = core(token)
    short = base(word)
    abbreviated = has_period(word) & (short.isin(*abbreviations) | short.rlike(r"^\p{L}$"))
    return token.rlike(r"[.!?]$") & ~abbreviated


def _top(scores: DataFrame, least: float, most: int) -> list[str]:
    rows = scores.where(F.col("score") >= least).orderBy(F.col("score").desc(), "word").limit(most).select("word").collect()
    return sorted(r["word"] for r in rows)


def learn_sentence_ends(df: DataFrame, column: str, most: int = MOST_WORDS) -> SentenceEnds:
    """Abbreviations, then the sentence starters they leave, at most ``most`` of each."""
    abbreviations = _top(abbreviation_scores(df, column), ABBREVIATION_SCORE, most)
    return SentenceEnds(abbreviations, _top(starter_scores(df, column, abbreviations), STARTER_SCORE, most))


def learned_sentence_newlines(c: Column | str, ends: SentenceEnds) -> Column:
    """Put every sentence on its own line, by what was learned.

    ``!`` and ``?`` before white space end a sentence.  A period does, but not
    behind an abbreviation or a single letter, unless a capitalised word that
    starts sentences follows, and not behind a number before a small letter.
    White space inside a sentence stays as it is.
    """
    cut = F.split(strip_text(_col(c)), f"(?<=[.!?])(?={SPACE})")

    def joined(pieces: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            last = F.element_at(F.split(F.element_at(pieces, i), f"{SPACE}+"), -1)
            following = F.regexp_extract(p, f"^{SPACE}+({WORD})", 1)
            ends_here = _boundary(last, following, ends)
            line = F.concat(F.lit("\n"), F.regexp_replace(p, f"^{SPACE}+", ""))
            return F.when(i == 0, p).when(ends_here, line).otherwise(p)

        return F.array_join(F.transform(pieces, piece), "")

    return bound(cut, joined)


def _boundary(last: Column, following: Column, ends: SentenceEnds) -> Column:
    word = core(last)
    short = base(word)
    unsure = has_period(word) & (short.isin(*ends.abbreviations) | short.rlike(r"^\p{L}$"))
    starts = following.rlike(r"^[^\p{L}\p{N}]*\p{Lu}") & base(core(following)).isin(*ends.starters)
    ordinal = has_period(word) & short.rlike(r"^\p{N}+$") & following.rlike(r"^[^\p{L}\p{N}]*\p{Ll}")
    return last.rlike(r"[!?]$") | (F.when(unsure, starts).otherwise(~ordinal))
