"""Text columns: trimming, joining, word and sentence splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split()/str.strip() treat as white
# space.  Written out, because "\s" means something else in every regex engine.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a regex class, as few ranges as possible: long
# alternations of single characters are several times slower to match.
_CLASS = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{_CLASS}]"
WORD = f"[^{_CLASS}]+"
SENTENCE_END = f"([.!?]){SPACE}+"
# The same characters once more, for splitting whole texts in Java: letters below U+0100 are looked up in one table and
# then fail one range, where the class above tests them against eight.
_LOW = "".join(c for c in WHITESPACE if c < "\u0100")
_HIGH = "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
GAP = f"[{_LOW}[\u1680-\u3000&&[{_HIGH}]]]+"

# Separator between joined input columns, text of a missing value.
BLANK_LINE = "\n\n"
MISSING = "None"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c: Column | str) -> Column:
    """Trim white space at both ends.

    The character set goes through the Python API: inside a SQL string some
    of the escapes would turn into plain letters and trim those.
    """
    return F.btrim(_col(c), F.lit(WHITESPACE))


def words(c: Column | str) -> Column:
    """White-space separated words; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(_col(c), F.lit("")), GAP), "")


def word_count(c: Column | str) -> Column:
    """Number of white-space separated words; null and blank give 0."""
    return F.size(words(c))


def word_slice(c: Column | str, start: int | Column, length: int | Column) -> Column:
    """Words ``start`` .. ``start + length - 1`` (1-based), joined by one space."""
    return F.array_join(F.slice(words(c), start, length), " ")


def sentence_newlines(c: Column | str) -> Column:
    """Put every sentence on its own line.

    A sentence ends at ``.``, ``!`` or ``?`` followed by white space.
    """
    return F.regexp_replace(strip_text(c), SENTENCE_END, "$1\n")


def truncate_tokens(tokens: Column | str, max_len: int) -> tuple[Column, Column]:
    """First ``max_len`` tokens and whether anything was cut off."""
    tokens = _col(tokens)
    return F.slice(tokens, 1, max_len), F.size(tokens) > max_len


def joined_for_training(cols: Sequence[str]) -> Column:
    """Non-empty parts joined by a blank line, outer white space removed."""
    parts = [F.nullif(_text_form(F.col(c)), F.lit("")) for c in cols]
    return strip_text(F.concat_ws(BLANK_LINE, *parts))


def _text_form(c: Column) -> Column:
    """Any value as text; truth values are ``True`` and ``False``."""
    return F.when(F.typeof(c) == "boolean", F.initcap(c.cast("string"))).otherwise(c.cast("string"))


def as_text(c: Column | str) -> Column:
    """Text form of any value; a missing value becomes the text ``None``."""
    return F.coalesce(_text_form(_col(c)), F.lit(MISSING))


def joined_for_evaluation(cols: Sequence[str]) -> Column:
    """Text forms joined by a blank line; missing values stay visible."""
    return F.concat_ws(BLANK_LINE, *[as_text(c) for c in cols])


def model_short_name(path: Column | str) -> Column:
    """Last component of a model path or hub id."""
    return F.substring_index(_col(path), "/", -1)
