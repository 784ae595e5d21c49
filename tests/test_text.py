import pytest
from pyspark.sql import functions as F

from textpair.functions import text
from textpair.operators import curate


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value", ["of", "  of\t\n", "\x0c of\x0b\xa0", " wide　", "", " \n ", "a  b"])
def test_strip_and_words_match_python(spark, value):
    assert one(spark, value, text.strip_text("c")) == value.strip()
    assert one(spark, value, text.words("c")) == value.split()
    assert one(spark, value, text.word_count("c")) == len(value.split())


def test_words_end_at_the_same_characters_as_in_python(spark):
    every = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000] + ["\U0001f600", "\U00020000"]
    value = "".join(f"a{c}" for c in every)
    assert one(spark, value, text.words("c")) == value.split()
    inside = spark.createDataFrame([(c, f"a{c}b") for c in every], "c string, t string")
    found = inside.where(F.size(text.words("t")) == 2).collect()
    assert {r["c"] for r in found} == set(text.WHITESPACE)


def test_word_gaps_reject_letters_after_few_tests(spark):
    """Splitting whole texts took most of the time of queries on derived tables."""
    pattern, clock = spark._jvm.java.util.regex.Pattern, spark._jvm.java.lang.System.nanoTime
    value = "plain letters are no gaps " * 100_000

    def seconds(gap):
        start = clock()
        assert len(pattern.compile(gap).split(value)) == 500_000
        return clock() - start

    old, new = (min(seconds(gap) for _ in range(4)) for gap in (f"{text.SPACE}+", text.GAP))
    assert new < 0.8 * old


def test_word_count_of_null_is_zero(spark):
    assert one(spark, None, text.word_count("c")) == 0


def test_sentence_newlines(spark):
    assert one(spark, " One. Two!  Three? four.five ", text.sentence_newlines("c")) == "One.\nTwo!\nThree?\nfour.five"


@pytest.mark.parametrize("path,name", [("a/b/c", "c"), ("c", "c"), ("a/b/", "")])
def test_model_short_name(spark, path, name):
    assert one(spark, path, text.model_short_name("c")) == name


@pytest.mark.parametrize(
    "title,description,train,evaluation",
    [
        ("a", None, "a", "a\n\nNone"),
        ("a", "", "a", "a\n\n"),
        (" a ", "b", "a \n\nb", " a \n\nb"),
        (None, None, "", "None\n\nNone"),
    ],
)
def test_joins(spark, title, description, train, evaluation):
    df = spark.createDataFrame([(title, description)], "title string, description string")
    cols = ["title", "description"]
    assert curate.concat_input_train(df, cols).first()["input_text"] == train
    assert curate.concat_input_eval(df, cols).first()["input_text"] == evaluation


def test_stringify_metadata_absent_and_null(spark):
    df = spark.createDataFrame([(1, None)], "n int, t string")
    row = curate.stringify_metadata(df, ["n", "t", "missing"]).first()
    assert (row["n"], row["t"], row["missing"]) == ("1", "None", "")


def test_truncate_tokens(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "t array<string>")
    tokens, cut = text.truncate_tokens("t", 2)
    assert [tuple(r) for r in df.select(tokens, cut).collect()] == [(["a", "b"], True), (["a"], False)]


def test_union_variants_scan_the_table_once(spark, sf_dir):
    from textpair.catalog import tables

    plan = curate.union_curated(tables.products(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_similarity_filter_is_strict_and_rejects_nan(spark):
    df = spark.createDataFrame([(0.85,), (0.86,), (float("nan"),), (None,)], "similarity double")
    assert [r[0] for r in curate.similarity_filter(df).collect()] == [0.86]
    both = df.withColumns({"lang": F.lit("en")})
    assert curate.language_alignment_filter(both, 0.85).count() == 2
