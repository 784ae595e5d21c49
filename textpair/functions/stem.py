"""Suffix stripping after M. F. Porter, "An algorithm for suffix stripping" (1980).

Besides the published rules it follows the common later revisions used when
scoring summaries: words of up to two letters stay as they are, ``logi`` and
``bli`` endings, and the short list of irregular forms.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Irregular forms and the published suffix tables.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "fulli": "ful",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]

_VC = re.compile("V+C+")


def _shape(word: str) -> str:
    """Vowel/consonant pattern; ``y`` is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        if ch in "aeiou" or (ch == "y" and i and out[-1] == "C"):
            out.append("V")
        else:
            out.append("C")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(_VC.findall(_shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "V" in _shape(stem)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "C"


def _ends_cvc(word: str) -> bool:
    """Short syllable at the end: consonant-vowel-consonant, or a two-letter vowel-consonant word."""
    shape = _shape(word)
    if len(word) == 2:
        return shape == "VC"
    return shape.endswith("CVC") and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    hits = [s for s in suffixes if word.endswith(s)]
    return max(hits, key=len) if hits else None


def _plurals(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    if w.endswith("s") and not w.endswith("ss"):
        return w[:-1]
    return w


def _past_and_progressive(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if not _has_vowel(base):
                return w
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if _double_consonant(base):
                return base if base[-1] in "lsz" else base[:-1]
            if _measure(base) == 1 and _ends_cvc(base):
                return base + "e"
            return base
    return w


def _final_y(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "C":
        return w[:-1] + "i"
    return w


def _double_suffixes(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _double_suffixes(w[:-4] + "al")
    suffix = _longest(w, STEP_2)
    if suffix:
        base = w[: -len(suffix)]
        return base + STEP_2[suffix] if _measure(base) > 0 else w
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return w


def _adjectives(w: str) -> str:
    suffix = _longest(w, STEP_3)
    if suffix and _measure(w[: -len(suffix)]) > 0:
        return w[: -len(suffix)] + STEP_3[suffix]
    return w


def _residual(w: str) -> str:
    suffix = _longest(w, STEP_4)
    if suffix:
        base = w[: -len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base[-1] in "st"):
            return base
    return w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        base = w[:-1]
        m = _measure(base)
        if m > 1 or (m == 1 and not _ends_cvc(base)):
            w = base
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def porter_stem(word: str) -> str:
    """Stem of one lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (
        _plurals, _past_and_progressive, _final_y, _double_suffixes, _adjectives, _residual, _tidy,
    ):
        word = step(word)
    return word


@lru_cache(maxsize=1 << 17)
def stem_token(token: str) -> str:
    """Stem as used before matching: tokens of up to three letters stay."""
    return porter_stem(token) if len(token) > 3 else token


@F.pandas_udf(T.StringType())
def _stem_series(tokens: pd.Series) -> pd.Series:
    return tokens.map(stem_token, na_action="ignore")


def stem(c: Column | str) -> Column:
    """Stem of a token column; each worker remembers the tokens it has seen."""
    return _stem_series(F.col(c) if isinstance(c, str) else c)


def stem_vocabulary(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``(token, stem)`` for every distinct token of ``tokens``."""
    return tokens.select(F.col(token).alias("token")).distinct().withColumn("stem", stem("token"))
