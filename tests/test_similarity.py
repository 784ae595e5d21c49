import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textpair.functions import vectors
from textpair.operators import distributions, similarity


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine_similarity("a", "b")).collect()]
    assert got == [pytest.approx(1 / math.sqrt(2)), 0.0]


def test_text_cosine(spark):
    df = spark.createDataFrame([("a a b", "a b"), ("x", "y"), ("", "y"), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(vectors.text_cosine("a", "b")).collect()]
    assert got == [pytest.approx(3 / math.sqrt(10), abs=1e-6), 0.0, 0.0, 0.0]


def test_embedder(spark):
    def letters(texts):
        assert len(texts) == len(set(texts)), "every text of a batch once"
        return np.array([[t.count("a"), t.count("b")] for t in texts])

    rows = [("m", "ab", "aabb"), ("m", "a", "b"), ("m", "ab", "ab"), ("n", "a", "a"), ("m", "c", "a")]
    df = spark.createDataFrame(rows, "model string, target_query string, generated_output string").coalesce(1)
    got = similarity.semantic_similarity(df, "m", letters).collect()
    assert {(r["target_query"], r["generated_output"]): r["semantic_similarity"] for r in got} == {
        ("ab", "aabb"): 1.0, ("a", "b"): 0.0, ("ab", "ab"): 1.0, ("c", "a"): 0.0
    }
    dense = similarity.text_vectors(df.withColumn("product_id", F.lit(1)), "target_query", embedder=letters)
    assert sorted(r["vector"] for r in dense.collect()) == [[0, 0], [1, 0], [1, 0], [1, 1], [1, 1]]


def test_each_distinct_text_is_embedded_once_in_batches(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(texts):
        assert len(texts) <= 7
        calls.add(len(texts))
        return np.ones((len(texts), 2))

    rows = [(i, f"t{i % 30}" if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "product_id int, t string").repartition(6)
    assert similarity.text_vectors(df, "t", embedder=count, batch_size=7).count() == 300
    assert calls.value <= 31


def test_model_filter_runs_before_embedding(spark):
    def refuse(texts):
        assert "other" not in texts
        return np.ones((len(texts), 1))

    df = spark.createDataFrame([("m", "a", "b"), ("n", "other", "other")], "model string, target_query string, generated_output string")
    assert similarity.semantic_similarity(df, "m", refuse).count() == 1
    assert similarity.semantic_similarity(df, None, refuse).where("model = 'm'").columns[-1] == "semantic_similarity"


def test_histogram_and_correlation(spark):
    rows = [("m", i / 100, float(i), float(-i), 1.0, float(i * i)) for i in range(101)]
    df = spark.createDataFrame(rows, "model string, semantic_similarity double, rouge1 double, rouge2 double, rougeL double, rougeLsum double")
    bins = distributions.similarity_histogram(df, "m").collect()
    assert len(bins) == 25 and sum(b["n"] for b in bins) == 101
    pairs, correlation = distributions.similarity_vs_rouge(df, "m")
    assert pairs.count() == 404
    got = {r["metric"]: r["corr"] for r in correlation.collect()}
    assert got["rouge1"] == pytest.approx(1.0) and got["rouge2"] == pytest.approx(-1.0)


def test_two_embedders_of_one_class(spark):
    class Constant:
        def __init__(self, value):
            self.value = value

        def load(self):
            return lambda texts: np.full((len(texts), 1), self.value)

    df = spark.createDataFrame([(1, "a"), (2, "b")], "product_id int, t string").coalesce(1)
    for value in (1.0, 2.0):
        got = similarity.text_vectors(df, "t", embedder=Constant(value)).collect()
        assert {tuple(r["vector"]) for r in got} == {(value,)}


def test_term_counts_need_no_python(spark):
    """Terms of each row are counted by Spark itself: equal rows and keys stay apart, empty texts have none."""
    data = [(1, "b a B\nc, a a"), (1, "b a B\nc, a a"), (2, None), (3, "!?"), (None, "x1 x1 É x")]
    df = spark.createDataFrame(data, "product_id long, t string")
    got = similarity.text_vectors(df, "t")
    assert got.dtypes == [("product_id", "bigint"), ("token", "string"), ("tf", "bigint")]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted((str(r.product_id), r.token, r.tf) for r in got.collect())
    assert rows == sorted([("1", "a", 3), ("1", "b", 2), ("1", "c", 1)] * 2 + [("None", "x", 1), ("None", "x1", 2)])
