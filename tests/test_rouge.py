import random
import re
import tracemalloc
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textpair.functions import rouge

# Worked examples and edge cases: target, generated, four scores in percent.
GOLDEN = [
    ("flannel pajama set women's", "what to wear with a pajama set", 33.33, 20.0, 33.33, 33.33),
    ("flannel pajama set women's", "women's plaid pajama set", 80.0, 50.0, 40.0, 40.0),
    ("custom name necklace", "what is casey name necklace", 50.0, 33.33, 50.0, 50.0),
    ("custom name necklace", "personalized name necklace", 66.67, 50.0, 66.67, 66.67),
    ("Large Satin Sleep Cap", "what is the size of a silk bonnet", 0.0, 0.0, 0.0, 0.0),
    ("Large Satin Sleep Cap", "satin sleep cap", 85.71, 80.0, 85.71, 85.71),
    ("the cat sat.\nthe dog ran.", "the dog ran.\nthe cat sat.", 100.0, 80.0, 50.0, 100.0),
    ("café", "cafe", 0.0, 0.0, 0.0, 0.0),
    ("", "x", 0.0, 0.0, 0.0, 0.0),
    (None, "x", 0.0, 0.0, 0.0, 0.0),
    ("a a b", "a b b", 66.67, 50.0, 66.67, 66.67),
    ("one", "one", 100.0, 0.0, 100.0, 100.0),
]


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    return t


def plain_union_hits(ref_lines, pred_lines):
    """The definition, with the full table: slow but obviously right."""
    have_ref = Counter(x for line in ref_lines for x in line)
    have_pred = Counter(x for line in pred_lines for x in line)
    hits = 0
    for ref in ref_lines:
        union = set()
        for pred in pred_lines:
            t, i, j = table(ref, pred), len(ref), len(pred)
            while i and j:
                if ref[i - 1] == pred[j - 1]:
                    union.add(i - 1)
                    i, j = i - 1, j - 1
                elif t[i][j - 1] > t[i - 1][j]:
                    j -= 1
                else:
                    i -= 1
        for position in sorted(union):
            token = ref[position]
            if have_ref[token] and have_pred[token]:
                hits += 1
                have_ref[token] -= 1
                have_pred[token] -= 1
    return hits


def test_golden_rows(spark):
    rows = [(i, *g) for i, g in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "i int, ref string, pred string, w1 double, w2 double, wl double, ws double")
    scored = rouge.with_rouge_scores(df, "pred", "ref").orderBy("i").collect()
    for row in scored:
        got = (row["rouge1"], row["rouge2"], row["rougeL"], row["rougeLsum"])
        assert got == (row["w1"], row["w2"], row["wl"], row["ws"]), row


line = st.lists(st.sampled_from("abcd"), max_size=9)


@settings(max_examples=400, deadline=None)
@given(line, line)
def test_lcs_length_matches_the_table(a, b):
    assert rouge.lcs_length(a, b) == table(a, b)[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(line, max_size=4), st.lists(line, max_size=4))
def test_union_matches_the_definition(ref_lines, pred_lines):
    assert rouge.union_lcs_hits(ref_lines, pred_lines) == plain_union_hits(ref_lines, pred_lines)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=30), st.text(alphabet="ab \n", max_size=30))
def test_count_properties(a, b):
    n_pred, n_ref, o1, o2, lcs, union = rouge.pair_counts(a, b)
    assert o2 <= max(o1 - 0, 0) and lcs <= o1 <= min(n_pred, n_ref) and union <= o1
    assert rouge.pair_counts(b, a)[2:5] == (o1, o2, lcs)
    if "\n" not in a and "\n" not in b:
        assert union == lcs
    if a == b:
        assert o1 == lcs == union == n_pred and o2 == max(n_pred - 1, 0)


def test_long_texts_are_scored_whole():
    words = [f"w{i % 997}" for i in range(20_000)]
    assert rouge.lcs_length(words, words[1:]) == 19_999


def test_both_plans_agree_with_counting(spark):
    texts = [
        (1, "The cat, the CAT sat", "the cat sat on the cat"), (2, "", "a"), (3, "x", None),
        (4, "a b a b a b", "b a b a"), (5, "é è", "é"),
    ]
    df = spark.createDataFrame(texts, "id int, pred string, ref string")
    for n in (1, 2):
        local = {r["id"]: tuple(r["s"]) for r in df.select("id", rouge.rouge_n("pred", "ref", n).alias("s")).collect()}
        exploded = {r["id"]: tuple(r["s"]) for r in rouge.rouge_n_exploded(df, ["id"], "pred", "ref", n, "s").collect()}
        assert local == exploded
        for id_, pred, ref in texts:
            p, r = (re.findall("[a-z0-9]+", (x or "").lower()) for x in (pred, ref))
            grams = [Counter(zip(*[x[i:] for i in range(n)])) for x in (p, r)]
            o = sum((grams[0] & grams[1]).values())
            precision, recall = (o / max(sum(g.values()), 1) for g in grams)
            f = 2 * precision * recall / (precision + recall) if o else 0.0
            assert local[id_] == pytest.approx((precision, recall, f))


def test_stemming_is_a_flag(spark):
    df = spark.createDataFrame([("running dogs", "run dog")], "pred string, ref string")
    plain = rouge.with_rouge_scores(df, "pred", "ref").first()
    stemmed = rouge.with_rouge_scores(df, "pred", "ref", stem=True).first()
    assert plain["rouge1"] == 0.0 and stemmed["rouge1"] == 100.0


def test_scoring_is_one_python_step_without_shuffle(spark):
    df = spark.range(10).select(F.lit("a").alias("pred"), F.lit("b").alias("ref"))
    scored = rouge.with_rouge_scores(df.withColumn("model", F.lit("m")), "pred", "ref")
    for result in (scored, scored.where("rougeL >= 50 and rouge1 < 90")):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_other_filters_run_before_scoring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = rouge.with_rouge_scores(docs, "text", "source").where("lang = 'en' and rougeL > 0")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan


def test_rouge_n_row_local_is_not_quadratic(spark):
    """Long equal texts: the row-local plan agrees with the exploded one and with counting."""
    text = " ".join(f"w{i % 700}" for i in range(6000))
    df = spark.createDataFrame([(1, text, text + " extra"), (2, "", "a"), (3, "a b a", "a a c")], "k int, a string, b string")
    for n in (1, 2, 3):
        local = {r["k"]: r["s"] for r in df.select("k", rouge.rouge_n("a", "b", n).alias("s")).collect()}
        exploded = {r["k"]: r["score"] for r in rouge.rouge_n_exploded(df, ["k"], "a", "b", n).collect()}
        assert local == exploded


@pytest.mark.parametrize("kept, block", [(1, 1), (2, 3), (512, 64)])
def test_checkpointed_walk_finds_the_same_positions(monkeypatch, kept, block):
    monkeypatch.setattr(rouge, "KEPT_MASKS", kept)
    monkeypatch.setattr(rouge, "LEAST_BLOCK", block)
    rng = random.Random(kept)
    for size in (1, 2, 5, 40, 90):
        for words in (1, 2, 6, 60):
            ref, pred = ([[str(rng.randrange(words)) for _ in range(rng.randint(0, size))] for _ in range(2)] for _ in range(2))
            assert rouge.union_lcs_hits(ref, pred) == plain_union_hits(ref, pred)
            assert rouge.lcs_length(ref[0], pred[0]) == table(ref[0], pred[0])[-1][-1]


def test_long_lines_in_bounded_memory():
    """Two lines of 60,000 words, most of them rare."""
    rng = random.Random(5)
    ref = [f"w{int(rng.paretovariate(0.3)) % 50_000}" for _ in range(60_000)]
    pred = [w if rng.random() < 0.8 else "x" for w in ref]
    tracemalloc.start()
    n_pred, n_ref, _, _, lcs, union = rouge.pair_counts(" ".join(pred) + "\nend", " ".join(ref))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n_pred, n_ref) == (60_001, 60_000) and 45_000 < lcs == union < 55_000
    assert peak < 120_000_000


def test_exploded_tasks_follow_the_texts(spark, monkeypatch):
    """A task groups a bounded number of characters, however small the compressed texts are."""
    monkeypatch.setattr(rouge, "CHARS_PER_TASK", 1_000)
    df = spark.createDataFrame([(i, "a b c " * 100, "a c") for i in range(100)], "k int, p string, r string")
    found = rouge.rouge_n_exploded(df, ["k"], "p", "r", 1)
    assert found.rdd.getNumPartitions() >= 60 and found.count() == 100
    assert rouge.rouge_n_exploded(df.where("false"), ["k"], "p", "r", 1).count() == 0
