import hashlib

import pytest
from pyspark.sql import functions as F

from textpair.operators import sampling


@pytest.mark.parametrize("n", [1, 7, 500, 1999, 2000, 5000])
def test_seeded_sample_is_the_n_smallest_hashes(spark, n):
    df = spark.range(2000).withColumnRenamed("id", "product_id")
    order = sorted(range(2000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    for parts in (1, 9):
        got = {r["product_id"] for r in sampling.seeded_sample(df.repartition(parts), n).collect()}
        assert got == set(order[:n])


def test_no_sample_keeps_everything(spark):
    df = spark.range(10).withColumnRenamed("id", "product_id")
    assert sampling.seeded_sample(df, None).count() == sampling.seeded_sample(df, 0).count() == 10


def test_crowded_prefixes_still_give_n_rows(spark, monkeypatch):
    monkeypatch.setattr(sampling, "STEP_DIGITS", 1)
    df = spark.range(3000).withColumnRenamed("id", "product_id")
    order = sorted(range(3000), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
    got = {r["product_id"] for r in sampling.seeded_sample(df, 1000, 7).collect()}
    assert got == set(order[:1000])


def test_equal_keys_at_the_boundary_give_n_rows(spark):
    df = spark.range(100).select(F.lit(1).alias("product_id"), F.col("id").alias("row"))
    assert sampling.seeded_sample(df, 30).count() == 30


def test_sample_has_no_window_or_shuffle(spark):
    df = spark.range(2000).withColumnRenamed("id", "product_id")
    plan = sampling.seeded_sample(df, 500)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_dev_head_takes_each_split(spark):
    df = spark.range(1000).select(
        F.col("id").alias("product_id"), F.when(F.col("id") % 10 == 0, "test").otherwise("train").alias("split")
    )
    got = sampling.dev_head(df.repartition(7), 30).collect()
    for split, ids in (("test", range(0, 1000, 10)), ("train", [i for i in range(1000) if i % 10])):
        assert sorted(r["product_id"] for r in got if r["split"] == split) == list(ids)[:30]


def test_first_rows_overall(spark):
    df = spark.range(5000).repartition(13)
    assert [r["id"] for r in sampling.first_rows(df, [F.desc("id")], 3).collect()] == [4999, 4998, 4997]
