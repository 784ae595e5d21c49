import pytest

from textpair.operators import vocab
from textpair.plans.prepare import prepare_dataset

ROWS = [
    (1, "b b a", "c", "b"), (2, "A a, a!", None, "zzz b"), (3, "", "", ""), (4, "a " * 700, "b", "c " * 50),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "product_id int, title string, description string, short_query string")


def test_vocab_order(spark, df):
    small = spark.createDataFrame([("b b b a a c",), ("c d",)], "t string")
    got = {r["token"]: r["id"] for r in vocab.build_vocab(small, ["t"], 6).collect()}
    assert got == {"<pad>": 0, "</s>": 1, "<unk>": 2, "b": 3, "a": 4, "c": 5}


def test_encode(spark, df):
    words = vocab.build_vocab(df, ["title", "description"], 100)
    first, _, empty, long = vocab.encode_tokens(df, words, "title").orderBy("product_id").collect()
    assert first["input_ids"] == [4, 4, 3, 1] and first["labels"] == [4, 1]
    assert empty["input_ids"] == [1] and empty["attention_mask"] == [1]
    assert len(long["input_ids"]) == 512 and len(long["labels"]) == 30 and long["input_ids"][-1] == 1


def test_repeated_keys_and_nulls_stay_rows(spark, df):
    words = vocab.build_vocab(df, ["title", "description"], 100)
    rows = spark.createDataFrame([(1, "a", "b"), (1, "b a", "b"), (None, None, None)], "product_id int, input_text string, short_query string")
    got = sorted((r["product_id"] or 0, r["input_ids"], r["labels"]) for r in vocab.encode_tokens(rows, words).collect())
    assert got == [(0, [1], [1]), (1, [3, 1], [4, 1]), (1, [4, 3, 1], [4, 1])]
    ids = spark.createDataFrame([(1, [3, 4]), (1, [4]), (2, None), (3, [3, None])], "product_id int, labels array<int>")
    assert sorted(r["text"] for r in vocab.decode_tokens(ids, words).collect()) == ["", "a", "a b", "b"]


def test_decode(spark, df):
    words = vocab.build_vocab(df, ["title", "description"], 100)
    ids = spark.createDataFrame([(1, [3, 2, -100, 4, 1, 0]), (2, []), (3, [1])], "product_id int, labels array<int>")
    got = vocab.decode_tokens(ids, words).orderBy("product_id").collect()
    assert [r["text"] for r in got] == ["a b", "", ""]


def test_vocabulary_needs_no_window_over_all_tokens(spark, df):
    for size in (500, 32_000):
        plan = vocab.build_vocab(df, ["title"], size)._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" not in plan.split("GlobalLimit")[-1] and "GlobalLimit" in plan


def test_prepare_dev_head(spark, df):
    from pyspark.sql import functions as F

    split = df.withColumn("split", F.lit("train"))
    words = vocab.build_vocab(df, ["title"], 10)
    assert prepare_dataset(split, words, dev=True).columns == ["product_id", "input_ids", "attention_mask", "labels"]
