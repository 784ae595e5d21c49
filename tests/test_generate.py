import pytest
from pyspark.sql import functions as F

from textpair.catalog import tables
from textpair.catalog.generators import GENERATORS
from textpair.operators import curate, generate


def inputs(spark, n=10):
    return spark.range(n).select(F.col("id").alias("product_id"), F.concat(F.lit("text "), "id").alias("input_text"))


def test_batches_and_order(spark):
    def sizes(texts):
        return [f"{t}|{len(texts)}" for t in texts]

    got = generate.batch_generate(inputs(spark).coalesce(1), {"org/x": sizes, "y": sizes}, batch_size=4).collect()
    assert len(got) == 20
    assert {(r["model_ord"], r["model_path"], r["model"]) for r in got} == {(0, "org/x", "x"), (1, "y", "y")}
    for r in got:
        text, size = r["generated_output"].split("|")
        assert text == r["input_text"] and int(size) in (4, 2)


def test_load_runs_in_the_task(spark):
    class Lazy:
        def load(self):
            suffix = "!"
            return lambda texts: [t + suffix for t in texts]

    got = generate.batch_generate(inputs(spark, 3), {"m": Lazy()}).collect()
    assert all(r["generated_output"] == r["input_text"] + "!" for r in got)


def test_wrong_number_of_outputs_is_an_error(spark):
    with pytest.raises(Exception, match="generator returned"):
        generate.batch_generate(inputs(spark), {"m": lambda texts: texts[:-1]}).collect()


def test_generators_equal_the_expressions(spark, sf_dir):
    rows = curate.concat_input_eval(tables.products(spark, sf_dir), tables.TEXT_COLS)
    key = ["product_id", "model", "generated_output"]
    python = generate.batch_generate(rows, GENERATORS).select(*key)
    spark_side = tables.generations(spark, sf_dir).select(*key)
    assert python.exceptAll(spark_side).count() == 0 == spark_side.exceptAll(python).count()


def test_row_by_model_is_no_join(spark):
    df = generate.row_by_model(inputs(spark, 2), ["a/b", "c"])
    assert df.count() == 4
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_align(spark):
    left = spark.createDataFrame([(1, "m", "in")], "product_id int, model string, input_text string")
    right = spark.createDataFrame([(1, "m", "out")], "product_id int, model string, generated_output string")
    assert generate.align_predictions(left, right).first()["generated_output"] == "out"
    with pytest.raises(Exception, match="more than one prediction"):
        generate.align_predictions(left, right.union(right)).collect()
    with pytest.raises(Exception, match="has no prediction"):
        generate.align_predictions(left.union(spark.createDataFrame([(2, "m", "x")], left.schema)), right).collect()
    with pytest.raises(Exception, match="has no input"):
        generate.align_predictions(left, right.union(spark.createDataFrame([(2, "m", "x")], right.schema))).collect()
    empty = spark.createDataFrame([(1, "m", None)], right.schema)
    assert generate.align_predictions(left, empty).first()["generated_output"] is None


def test_load_runs_once_per_worker(spark):
    class Counted:
        def load(self):
            import os
            import uuid

            token = f"{os.getpid()}:{uuid.uuid4().hex}"
            return lambda texts: [token for _ in texts]

    rows = inputs(spark, 40).repartition(20)
    tokens = {r["generated_output"] for r in generate.batch_generate(rows, {"counted/model": Counted()}).collect()}
    assert len(tokens) == len({t.split(":")[0] for t in tokens})


def suffixes():
    """A class whose objects load to a function that adds a number, and that refuse to share a worker."""
    class Suffix:
        def __init__(self, n):
            self.n = n

        def load(self):
            from textpair.operators import generate as shared

            def run(texts):
                assert len(shared.LOADED) == 1
                return [f"{t}:{n}" for t in texts]

            n = self.n
            return run

    return Suffix


def outputs(df, models):
    return {(r["model"], r["generated_output"].rsplit(":", 1)[1]) for r in generate.batch_generate(df, models).collect()}


def test_objects_of_one_class_under_one_path_are_told_apart(spark):
    df, Suffix = inputs(spark, 6).coalesce(1), suffixes()
    assert outputs(df, {"org/x": Suffix(1)}) == {("x", "1")}
    changed = Suffix(2)
    assert outputs(df, {"org/x": changed}) == {("x", "2")}
    changed.n = 3
    assert outputs(df, {"org/x": changed}) == {("x", "3")}


def test_one_loaded_model_per_worker(spark):
    """Many workers, several loaded models and a plain one: each worker holds one at a time."""
    df, Suffix = inputs(spark, 200).repartition(8), suffixes()
    models = {"a": Suffix(1), "p": lambda texts: [f"{t}:0" for t in texts], "b": Suffix(2), "c": Suffix(3)}
    got = generate.batch_generate(df, models).collect()
    assert {(r["model_ord"], r["model"], r["generated_output"].rsplit(":", 1)[1]) for r in got} == {
        (0, "a", "1"), (1, "p", "0"), (2, "b", "2"), (3, "c", "3")
    }
    assert len(got) == 800 and len({(r["product_id"], r["model"]) for r in got}) == 800
    with pytest.raises(ValueError):
        generate.batch_generate(df, {})
