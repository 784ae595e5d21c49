import hashlib
import re

from textpair.llm import spotsigs


def brute(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    signs = set()
    for i, w in enumerate(words):
        if w in spotsigs.COMMON_WORDS:
            chain = [x for x in words[i + 1 :] if x not in spotsigs.COMMON_WORDS][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                signs.add((w, *chain))
    return signs or ({("", " ".join(words))} if words else set())


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


TEXTS = [
    "At a rally to kick off the campaign in the city of Springfield today", "", None, "word", "the of and", "!!!",
    "A man was on the bus to the old town", "A man was on the bus to the old town with a red dog",
    "le chat de la voisine et le chien du voisin", "der Hund und die Katze mit dem Ball", "😀 the smile of é face in rain",
    "the same words " * 500, "at a rally to kick off the campaign in the city of springfield today",
]


def test_equals_brute_force(spark):
    rows = [(i * 3 - 5, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in spotsigs.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(got) == len(rows)
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following, r = text or "", following or "", got[doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == 8 * len(brute(text)) and len(r.edited_fingerprint) == 8 * len(brute(edited))
        assert abs(r.near_edited - jaccard(brute(text), brute(edited))) < 1e-12
        assert abs(r.near_next - jaccard(brute(text), brute(following))) < 1e-12


def test_ids_null_repeated_and_tied(spark):
    rows = [(1, "the big cat sat"), (1, "the big cat sat"), (2, "of old men"), (2, "of two minds"), (None, "a b c"), (None, None)]
    got = spotsigs.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and sum(r.doc_id is None for r in got) == 2
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    (one,) = spotsigs.edited_likeness(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect()
    assert one.near_next == 1.0
    assert spotsigs.edited_likeness(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_pairs_equal_brute_force(spark):
    base = [f"the w{i} x{i} of" for i in range(40)]
    rows = [(k, " ".join(base[: 40 - k % 7] + [f"in e{k}a e{k}b"] * (k % 2))) for k in range(30)] + [(50, ""), (None, "the a b c")]
    rows += [(100 + k, f"the only text{k} here") for k in range(20)]
    pairs, members = spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    representative = {r.doc_id: r.representative for r in members.collect()}
    named = [(d, t) for d, t in rows if d is not None and brute(t)]
    for d, t in named:
        assert representative[d] == min(e for e, u in named if brute(u) == brute(t))
    want = set()
    kept = [(d, brute(t)) for d, t in named if representative[d] == d]
    for i, (a, x) in enumerate(kept):
        for b, y in kept[:i]:
            if jaccard(x, y) >= 0.8:
                want.add(frozenset((a, b)))
    assert {frozenset((r.a, r.b)) for r in pairs.collect()} == want
