"""The 1980 suffix-stripping rules as SQL, to check the stemmer with."""

from __future__ import annotations

# The published suffix tables and the irregular forms, written out
# here so that a slip in the stemmer's own tables shows.
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


def cut(w: str, n: int) -> str:
    return f"left({w}, -{n})"


def shape(w: str) -> str:
    """V and C per letter; each pass settles one more ``y`` of a row of them."""
    x = f"regexp_replace(regexp_replace(regexp_replace({w}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(4):
        x = f"regexp_replace(regexp_replace({x}, 'Cy', 'CV', 'g'), 'Vy', 'VC', 'g')"
    return x


def measure(w: str) -> str:
    return f"len(regexp_extract_all({shape(w)}, 'V+C+'))"


def ends_cvc(w: str) -> str:
    return f"(({shape(w)}) = 'VC' OR (({shape(w)}) LIKE '%CVC' AND right({w}, 1) NOT IN ('w', 'x', 'y')))"


def by_suffix(rules: dict[str, str], least: int, extra: dict[str, str] | None = None) -> str:
    """Only the longest suffix that fits is tried."""
    cases = []
    for suffix in sorted(rules, key=len, reverse=True):
        base = cut("w", len(suffix))
        more = (extra or {}).get(suffix, "true")
        cases.append(
            f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {measure(base)} > {least} AND {more} "
            f"THEN {base} || '{rules[suffix]}' ELSE w END"
        )
    return " ".join(cases)


def stems(source: str) -> str:
    """CTEs ending in ``stems(token, stem)`` for the tokens of ``source(token)``."""
    irregular = " ".join(f"WHEN token = '{w}' THEN '{s}'" for w, s in IRREGULAR.items())
    return f"""
st1 AS (SELECT token, CASE WHEN ends_with(token, 'ies') AND len(token) = 4 THEN {cut('token', 1)}
  WHEN ends_with(token, 'sses') OR ends_with(token, 'ies') THEN {cut('token', 2)}
  WHEN ends_with(token, 's') AND NOT ends_with(token, 'ss') THEN {cut('token', 1)} ELSE token END AS w
  FROM {source} WHERE len(token) > 3),
st2 AS (SELECT token, w, CASE WHEN ends_with(w, 'ied') OR ends_with(w, 'eed') THEN NULL
  WHEN ends_with(w, 'ed') AND ({shape(cut('w', 2))}) LIKE '%V%' THEN {cut('w', 2)}
  WHEN ends_with(w, 'ing') AND ({shape(cut('w', 3))}) LIKE '%V%' THEN {cut('w', 3)} END AS b FROM st1),
st3 AS (SELECT token, CASE
  WHEN ends_with(w, 'ied') THEN CASE WHEN len(w) = 4 THEN {cut('w', 1)} ELSE {cut('w', 2)} END
  WHEN ends_with(w, 'eed') THEN CASE WHEN {measure(cut('w', 3))} > 0 THEN {cut('w', 1)} ELSE w END
  WHEN b IS NULL THEN w
  WHEN ends_with(b, 'at') OR ends_with(b, 'bl') OR ends_with(b, 'iz') THEN b || 'e'
  WHEN len(b) > 1 AND right(b, 1) = left(right(b, 2), 1) AND right({shape('b')}, 1) = 'C' THEN
    CASE WHEN right(b, 1) IN ('l', 's', 'z') THEN b ELSE {cut('b', 1)} END
  WHEN {measure('b')} = 1 AND {ends_cvc('b')} THEN b || 'e' ELSE b END AS w FROM st2),
st4 AS (SELECT token, CASE WHEN ends_with(w, 'y') AND len(w) > 2 AND right({shape(cut('w', 1))}, 1) = 'C'
  THEN {cut('w', 1)} || 'i' ELSE w END AS w FROM st3),
st5 AS (SELECT token, CASE WHEN ends_with(w, 'alli') AND {measure(cut('w', 4))} > 0 THEN {cut('w', 2)} ELSE w END AS w FROM st4),
st6 AS (SELECT token, CASE {by_suffix(STEP_2, 0)}
  WHEN ends_with(w, 'logi') AND {measure(cut('w', 3))} > 0 THEN {cut('w', 1)} ELSE w END AS w FROM st5),
st7 AS (SELECT token, CASE {by_suffix(STEP_3, 0)} ELSE w END AS w FROM st6),
st8 AS (SELECT token, CASE {by_suffix({s: '' for s in STEP_4}, 1, {'ion': f"right({cut('w', 3)}, 1) IN ('s', 't')"})} ELSE w END AS w FROM st7),
st9 AS (SELECT token, CASE WHEN ends_with(w, 'e') AND ({measure(cut('w', 1))} > 1
  OR ({measure(cut('w', 1))} = 1 AND NOT {ends_cvc(cut('w', 1))})) THEN {cut('w', 1)} ELSE w END AS w FROM st8),
stems AS (
  SELECT token, CASE {irregular} WHEN ends_with(w, 'll') AND {measure(cut('w', 1))} > 1 THEN {cut('w', 1)} ELSE w END AS stem FROM st9
  UNION ALL SELECT token, token FROM {source} WHERE len(token) <= 3)"""
