import math
import random
import re
from collections import Counter

import pytest

from textpair.operators import sentences as se

TEXTS = [
    "Dr. Smith met J. Doe.", "He saw Dr. Jones at 5 p.m. on Monday. The clinic was full!", "Is Dr. Brown in? No. He left.",
    "On the 3. of May Dr. Gray sat. The dog ran.", "It was late. The end.", "Mr. Dr. Who?", "", None, "They came. The rain fell. The sun rose.",
    "What... she said. The cat (e.g. a tabby) slept.", "Prices rose by 5. Then they fell.",
]


# The same words inside sentences.
PLAIN = ["late dogs ran off, fell and left; end it full, she said doe came in and sat no more on monday then slept of rain"] * 3


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string")


def core(token):
    return re.sub(r"[^\w.]+$", "", re.sub(r"^[\W_]+", "", token)).lower()


def brute_scores(texts):
    n_period, n_plain = Counter(), Counter()
    for text in texts:
        for token in (text or "").split():
            word = core(token)
            (n_period if re.search(r"[^.]\.$", word) else n_plain)[word.rstrip(".")] += 1
    periods, n = sum(n_period.values()), sum(n_period.values()) + sum(n_plain.values())
    out = {}
    for word, k in n_period.items():
        if not re.fullmatch(r"[a-z.-]*[a-z][a-z.-]*", word):
            continue
        plain, p = n_plain[word], periods / n
        null = k * math.log(p) + plain * math.log(1 - p)
        alternative = k * math.log(0.99) + plain * math.log(0.01)
        letters, dots = len(word) - word.count("."), word.count(".") + 1
        out[word] = (k, plain, -2 * (null - alternative) * math.exp(-letters) * dots * letters ** -plain)
    return out


def test_scores_equal_brute_force(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["dr.", "Dr.", "cat", "cat.", "u.s.", "x-y.", "(no.)", "no", "'a.'", "7."]) for _ in range(30)) for _ in range(20)]
    got = {r.word: (r.n_period, r.n_plain, r.score) for r in se.abbreviation_scores(rows(spark, texts), "t").collect()}
    want = brute_scores(texts)
    assert got.keys() == want.keys()
    for word, (k, plain, score) in want.items():
        assert got[word][:2] == (k, plain) and got[word][2] == pytest.approx(score, rel=1e-9), word


def test_starters_equal_the_likelihood_ratio(spark):
    df = rows(spark, TEXTS * 5)
    got = {r.word: (r.n, r.n_start, r.score) for r in se.starter_scores(df, "t", ["dr", "mr", "p.m", "e.g"]).collect()}
    n, starts, total, breaks = Counter(), Counter(), 0, 0
    for text in TEXTS * 5:
        before = None
        for token in (text or "").split():
            word = core(token).rstrip(".")
            ended = before is not None and before[-1] in ".!?" and not (
                re.search(r"[^.]\.$", core(before)) and (core(before)[:-1] in ("dr", "mr", "p.m", "e.g") or re.fullmatch("[a-z]", core(before)[:-1]))
            )
            n[word] += 1
            starts[word] += ended
            total, breaks, before = total + 1, breaks + ended, token
    k11, k12 = starts["the"], breaks - starts["the"]
    k21, k22 = n["the"] - k11, total - breaks - n["the"] + k11
    def entropy(*cells):
        return sum(c * math.log(c / sum(cells)) for c in cells if c)
    ratio = 2 * (entropy(k11, k12, k21, k22) - entropy(k11 + k12, k21 + k22) - entropy(k11 + k21, k12 + k22))
    assert got["the"][:2] == (n["the"], k11) and got["the"][2] == pytest.approx(ratio, rel=1e-9) and ratio > se.STARTER_SCORE


def test_learned_ends(spark):
    ends = se.learn_sentence_ends(rows(spark, TEXTS * 20 + PLAIN * 20), "t")
    assert "dr" in ends.abbreviations and "the" in ends.starters and "late" not in ends.abbreviations
    texts = TEXTS + ["Dr.\n Smith  met\tJ. Doe. \n", "By Dr. The end.", "a. b", "x\u00a0yy.\u2003Z. Q"]
    got = [r[0] for r in rows(spark, texts).orderBy("id").select(se.learned_sentence_newlines("t", ends)).collect()]
    assert got[0] == "Dr. Smith met J. Doe."
    assert got[2] == "Is Dr. Brown in?\nNo.\nHe left."
    assert got[3] == "On the 3. of May Dr. Gray sat.\nThe dog ran."
    assert got[6:8] == ["", None] and got[10] == "Prices rose by 5.\nThen they fell."
    assert got[11] == "Dr.\n Smith  met\tJ. Doe." and got[12] == "By Dr.\nThe end."
    assert got[14] == "x\u00a0yy.\nZ. Q"


def test_without_anything_learned_only_initials_and_ordinals_differ(spark):
    from textpair.functions.text import sentence_newlines

    texts = ["One. Two! Three?  four.", "no end", "Mr. X came. So", "...", "a.b. c"]
    df = rows(spark, texts)
    got = df.orderBy("id").select(se.learned_sentence_newlines("t", se.SentenceEnds()), sentence_newlines("t")).collect()
    assert all(r[0] == r[1] for r in got)
    assert se.learn_sentence_ends(df.where("false"), "t") == se.SentenceEnds([], [])


def test_splitting_needs_no_python_and_no_shuffle(spark):
    plan = rows(spark, TEXTS).select(se.learned_sentence_newlines("t", se.SentenceEnds(["dr"], ["the"])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan
