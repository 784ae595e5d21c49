import math
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textpair.functions.rouge import with_rouge_scores
from textpair.operators import averages, compare, distributions

COLUMNS = "target_query string, model string, generated_output string, rouge1 double, rouge2 double, rougeL double, rougeLsum double, row_ord long"
NAN = float("nan")


def results(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], COLUMNS)


def row(target, model, output, score):
    return (target, model, output, score, score, score, score)


@pytest.fixture(scope="module")
def many(spark):
    """Many equal targets and copies: one target holds most rows."""
    rows = []
    for i in range(60):
        target = "hot" if i % 3 else f"t{i % 5}"
        rows.append(row(target, "a", f"out{i % 4}", float(i * 7 % 11) * 10))
        rows.append(row(target, "b", f"out{i % 3}", float(i * 5 % 11) * 10))
    rows.append(row(None, "a", "x", 50.0))
    rows.append(row(None, "b", "y", 40.0))
    return rows


@pytest.mark.parametrize("null_safe", [True, False])
def test_outperformed_keeps_every_pair(spark, many, null_safe):
    expected = Counter()
    for a in many:
        for b in many:
            if a[1] == "a" and b[1] == "b" and a[0] == b[0] and (null_safe or a[0] is not None):
                if all(x > y for x, y in zip(a[3:], b[3:])):
                    expected[(a[0], a[2], b[2])] += 1
    got = compare.outperformed_rows(results(spark, many), "a", "b", null_safe)
    assert got.columns == ["target_query", "generated_output_a", "generated_output_b"]
    assert Counter(tuple(r) for r in got.collect()) == expected
    assert sum(expected.values()) > 300


def test_outperformed_ignores_nan(spark):
    rows = [row("t", "a", "x", NAN), row("t", "b", "y", 1.0), row("t", "a", "z", 5.0), row("t", "b", "w", NAN)]
    assert [tuple(r) for r in compare.outperformed_rows(results(spark, rows), "a", "b").collect()] == [("t", "z", "y")]


def test_scoring_below_outperformed_rows_compiles(spark):
    """The scores were inlined into the test of the rows: more code than a method may have, so Spark ran it uncompiled."""
    rows = [("t", "a", "one two"), ("t", "b", "two three"), ("two three\nfour", "a", "two three four"), ("two three\nfour", "b", "two four")]
    df = spark.createDataFrame(rows, "target_query string, model string, generated_output string")
    scored = with_rouge_scores(df, "generated_output", "target_query")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = compare.outperformed_rows(scored, "a", "b").collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert [tuple(r) for r in got] == [("two three\nfour", "two three four", "two four")]


def test_other_models_are_not_scored(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def watched(scores):
        seen.add(len(scores))
        return scores

    rows = [row("t", m, f"{m}{i}", s) for i in range(10) for m, s in (("a", 60.0), ("b", 40.0), ("c", 900.0), (None, 50.0))]
    df = results(spark, rows).withColumn("rouge1", watched("rouge1"))
    assert compare.outperformed_rows(df, "a", "b").count() == 100
    assert seen.value == 20


def test_copies_come_in_steps_that_stay_small(spark):
    """A task holds the rows of a step at once, so the copies of a pair are dealt in steps of at most a thousand."""
    df = spark.createDataFrame([("a", 25_001)], "k string, n long")
    repeated = compare.repeat_rows(df, "n").select("k", F.spark_partition_id().alias("task"))
    assert compare.REPEAT_CHUNK <= 1_000
    tasks = {r["task"]: r["count"] for r in repeated.groupBy("task").count().collect()}
    assert sum(tasks.values()) == 25_001 and len(tasks) > 4


def test_repeat_rows_in_chunks(spark):
    df = spark.createDataFrame([("a", 25_001), ("b", 1), ("c", 10_000)], "k string, n long")
    assert {r["k"]: r["count"] for r in compare.repeat_rows(df, "n").groupBy("k").count().collect()} == {
        "a": 25_001, "b": 1, "c": 10_000,
    }


def test_slices(spark):
    rows = [row("t", "a", "x", NAN), row("t", "a", "y", 50.0), row("t", "a", "z", 0.0), row("t", "b", "w", 90.0)]
    df = results(spark, rows)
    assert [r["generated_output"] for r in compare.best_rows(df, "a").collect()] == ["y"]
    assert [r["generated_output"] for r in compare.worst_rows(df, "a").collect()] == ["z"]
    assert [r["generated_output"] for r in compare.zero_score_rows(df, "a").collect()] == ["z"]
    with pytest.raises(ValueError):
        compare.model_pair_filter(df, ["a"])


def test_pair_choice(spark):
    def pair(models, positions=(0, 1)):
        df = results(spark, [row("t", m, "x", 1.0) for m in models])
        return averages.select_model_pair(averages.models_in_order(df), positions)

    assert pair(["z", "a"], (0, 2)) == ("z", "a")
    assert pair(["z", "a", "m"], (0, 2)) == ("z", "m")
    with pytest.raises(ValueError):
        pair(["z"])


def test_averages_by_size(spark):
    rows = [row("t", "a", "one", 10.0), row("t", "a", "two words", 30.0), row("t", "a", None, 2.0), row("t", "a", "1 2", NAN)]
    by_size = averages.avg_scores_by_size(results(spark, rows), "a")
    assert [(r["size"], r["rouge1_avg"]) for r in by_size.collect()] == [(0, 2.0), (1, 10.0), (2, 30.0)]
    assert [r["rouge1_diff"] for r in averages.size_score_diff(by_size).orderBy("size").collect()] == [0.0, 8.0, 20.0]
    lengths = averages.output_length_range(results(spark, rows), "a").first()
    assert tuple(lengths) == (2, 0)


def test_histogram_of_equal_values(spark):
    rows = [row("t", m, "x", 40.0) for m in ("a", "b") for _ in range(3)]
    bins = distributions.score_histogram(results(spark, rows), ["a", "b"]).where("model = 'a' and metric = 'rouge1'").collect()
    assert len(bins) == 20 and sum(b["n"] for b in bins) == 3
    assert [b for b in bins if b["n"]][0]["lo"] == 40.0


def test_histogram_closes_the_last_bin(spark):
    values = [0.0, 5.0, 99.99, 100.0, NAN]
    rows = [row("t", "a", "x", v) for v in values] + [row("t", "b", "x", 1.0)]
    bins = {b["bin"]: b["n"] for b in distributions.score_histogram(results(spark, rows), ["a", "b"]).where("model = 'a' and metric = 'rougeL'").collect()}
    assert bins[1] == 1 and bins[2] == 1 and bins[20] == 2 and sum(bins.values()) == 4


def test_density_matches_the_formula(spark):
    values = [1.0, 2.0, 2.0, 7.0, 9.5]
    df = spark.createDataFrame([("a", "m", v) for v in values] + [("b", "m", 3.0)] * 2, "model string, metric string, value double")
    got = distributions.density(df, grid=5).orderBy("x").collect()
    h = statistics.stdev(values) * len(values) ** -0.2
    lo, hi = min(values) - 3 * h, max(values) + 3 * h
    assert {r["model"] for r in got} == {"a"} and len(got) == 5
    for i, r in enumerate(got):
        x = lo + (hi - lo) * i / 4
        d = sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in values) / (len(values) * h * math.sqrt(2 * math.pi))
        assert (r["x"], r["density"]) == (pytest.approx(x, abs=1e-5), pytest.approx(d, abs=1e-5))


def test_density_and_histogram_of_many_distinct_values(spark):
    """40,000 distinct values in two far clumps: no window, empty points are 0, the same curve as all pairs."""
    df = spark.range(40_000).select(
        F.lit("a").alias("model"), F.lit("m").alias("metric"),
        (F.col("id") * 0.0001 + F.when(F.col("id") % 2 == 0, 1000.0).otherwise(0.0)).alias("value"),
    )
    values = np.array([r["value"] for r in df.select("value").collect()])
    curve = distributions.density(df)
    got = curve.orderBy("x").collect()
    h = values.std(ddof=1) * len(values) ** -0.2
    x = np.linspace(values.min() - 3 * h, values.max() + 3 * h, 200)
    want = np.array([np.exp(-0.5 * ((at - values) / h) ** 2).sum() for at in x]) / (len(values) * h * math.sqrt(2 * math.pi))
    assert np.allclose([r["x"] for r in got], x, atol=1e-4) and np.allclose([r["density"] for r in got], want, atol=1e-6)
    narrow = distributions.density(df.where("value < 1 or value > 1003"), grid=400).orderBy("x").collect()
    assert len(narrow) == 400 and min(r["density"] for r in narrow) == 0.0
    bins = distributions.histogram(df, 20)
    assert sum(r["n"] for r in bins.collect()) == 40_000
    for plan in (curve, bins):
        assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()


def test_groups_without_a_name_keep_their_distribution(spark):
    df = spark.createDataFrame([(None, "m", float(v)) for v in (1, 2, 4)], "model string, metric string, value double")
    assert distributions.density(df, grid=5).count() == 5
    assert sum(r["n"] for r in distributions.histogram(df, 4).collect()) == 3


def test_bootstrap_brackets_the_mean(spark):
    df = spark.range(4000).select(
        F.col("id").alias("k"), *[((F.col("id") * 37) % 101).cast("double").alias(c) for c in compare.SCORE_COLUMNS]
    )
    mean = df.agg(F.avg("rouge1")).first()[0]
    got = averages.corpus_rouge_bootstrap(df, "k", ["rouge1"], resamples=400).first()
    assert got["low"] < got["mid"] < got["high"] and abs(got["mid"] - mean) < 0.3
    width = 2 * 1.96 * 29.15 / math.sqrt(4000)
    assert 0.75 * width < got["high"] - got["low"] < 1.25 * width
    again = averages.corpus_rouge_bootstrap(df.repartition(3), "k", ["rouge1"], resamples=400).first()
    assert again == got


def test_corpus_rouge(spark):
    df = spark.createDataFrame([("a b", "a b"), ("a", "b")], "pred string, ref string")
    assert tuple(averages.corpus_rouge(df).first()) == (50.0, 50.0, 50.0, 50.0)


def test_model_gap_is_ordered(spark):
    rows = [("t", "a", "x", 90.0, 80.0, 70.0, 60.0), ("t", "b", "x", 80.0, 20.0, 65.0, 59.0)]
    got = averages.model_gap(results(spark, rows), "a", "b").collect()
    assert [(r["metric"], r["gap"]) for r in got] == [("rouge2", 60.0), ("rouge1", 10.0), ("rougeL", 5.0), ("rougeLsum", 1.0)]


def test_side_by_side(spark):
    rows = [row("t", "a", "x", 1.0), row("t", "b", "y", 1.0), row("t", "c", "z", 1.0)]
    df = results(spark, rows).withColumn("product_id", F.lit(1))
    assert [tuple(r) for r in compare.side_by_side_outputs(df, "a", "b").collect()] == [(1, "t", "x", "y")]


def test_two_outputs_of_one_model_raise(spark):
    df = results(spark, [row("t", "a", "x", 1.0), row("t", "a", "y", 1.0)]).withColumn("product_id", F.lit(1))
    with pytest.raises(Exception, match="more than one output"):
        compare.side_by_side_outputs(df, "a", "b").collect()


def test_scores_outside_percentages_raise(spark):
    df = results(spark, [row("t", "a", "x", 900.0), row("t", "b", "y", 1.0)])
    with pytest.raises(Exception, match="percentage"):
        compare.outperformed_rows(df, "a", "b").collect()


def test_copies_of_one_row_come_from_several_tasks(spark):
    df = results(spark, [row("t", "a", "x", 60.0)] * 300 + [row("t", "b", "y", 40.0)] * 300)
    assert [r["n"] for r in compare.outperformed_rows(df, "a", "b", counted=True).collect()] == [90_000]
    got = compare.outperformed_rows(df, "a", "b").withColumn("task", F.spark_partition_id())
    tasks = {r["task"]: r["count"] for r in got.groupBy("task").count().collect()}
    assert sum(tasks.values()) == 90_000 and len(tasks) > 2


def test_hot_target_is_split_over_tasks(spark):
    """One target holds a third of the rows: its join partition must be split."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        # As on a cluster, the counted rows come from many tasks.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "24",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        i = F.col("id")
        target = F.when(i % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.floor(i / 2)))
        score = F.when(i % 50 == 0, 60.0).otherwise(40.0)
        rows = spark.range(6000).select(
            target.alias("target_query"),
            F.when(F.floor(i / 3) % 2 == 0, "a").otherwise("b").alias("model"),
            F.concat(F.lit("output "), i).alias("generated_output"),
            *[score.alias(c) for c in compare.SCORE_COLUMNS],
        )
        got = compare.outperformed_rows(rows, "a", "b")
        hot = rows.where("target_query = 'hot'").groupBy("model", "rouge1").count().collect()
        counts = {(r["model"], r["rouge1"]): r["count"] for r in hot}
        expected_hot = counts[("a", 60.0)] * counts[("b", 40.0)]
        assert len([r for r in got.collect() if r["target_query"] == "hot"]) == expected_hot
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
