import pytest

from textpair.catalog import tables
from textpair.catalog.generators import GENERATORS
from textpair.functions.rouge import SCORE_COLUMNS
from textpair.plans.analyze import analyze_results
from textpair.plans.evaluate import evaluate_models
from textpair.session import shared_dir
from textpair.streaming.evaluate import append_available, stream_evaluate


def test_evaluation_keeps_raw_outputs_and_split_targets(spark):
    df = spark.createDataFrame([(1, "x y", "One. Two. ")], "product_id int, title string, short_query string")
    rows = evaluate_models(df, {"org/echo": lambda texts: ["One. Two." for _ in texts]}, ["title", "absent"][:1]).collect()
    (row,) = rows
    assert row["target_query"] == "One.\nTwo." and row["generated_output"] == "One. Two."
    assert [row[c] for c in SCORE_COLUMNS] == [100.0] * 4 and row["model"] == "echo" and row["input_text"] == "x y"


def test_evaluation_has_no_shuffle_and_generates_once(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS product_id", "text AS title", "lang AS short_query")
    plan = evaluate_models(df, GENERATORS, ["title"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython [outputs") == 1


def test_sampled_evaluation(spark, sf_dir):
    assert evaluate_models(tables.products(spark, sf_dir), GENERATORS, ["title"], sample=20).count() == 60


def test_stream_equals_batch(spark, sf_dir):
    products = tables.products(spark, sf_dir)
    path = shared_dir(spark, "examples")
    products.write.parquet(path)
    stream = spark.readStream.schema(products.schema).option("maxFilesPerTrigger", 3).parquet(path)
    out = shared_dir(spark, "scored")
    append_available(stream_evaluate(stream, GENERATORS), out, shared_dir(spark, "cp"), ["model"])
    batch = evaluate_models(products, GENERATORS)
    got = spark.read.parquet(out).select(*batch.columns)
    assert got.count() == batch.count()
    assert got.exceptAll(batch).count() == 0


def test_analysis_reports(spark, sf_dir):
    results = tables.results(spark, sf_dir).cache()
    path = shared_dir(spark, "saved")
    reports = analyze_results(results, (0, 1), "row_ord", compute_similarity=True, save_path=path, save=["outperformed", "zeros"])
    assert reports["models"].count() == 3 and reports["averages"].count() == 3
    assert reports["histogram"].select("model").distinct().count() == 2
    assert reports["zeros"].where("model <> 'lead'").count() == 0
    better = spark.read.option("header", True).csv(f"{path}/better_mid")
    assert better.columns == ["target_query", "generated_output_mid", "generated_output_lead"]
    assert reports["by_size_diff"].count() == reports["by_size"].count()
    with pytest.raises(ValueError):
        analyze_results(results, order="row_ord", save=["best"])
    results.unpersist()


def test_copies_of_targets_do_not_multiply(spark, sf_dir, monkeypatch):
    """The written slice and the report hold equal pairs once, with their number."""
    from textpair.catalog import queries
    from textpair.catalog import tables
    from textpair.operators import compare

    held = {}
    write = queries.result_files.write_case_slices
    monkeypatch.setattr(queries.result_files, "write_case_slices", lambda slices, path: held.update(slices) or write(slices, path))
    pairs = compare.outperformed_rows(tables.results(spark, sf_dir), "mid", "lead")
    found = {r["slice"]: r["n"] for r in queries.QUERIES["write_case_slices"](spark, sf_dir).collect()}
    assert found["better_mid"] == pairs.count() > held["better_mid"].count() == pairs.distinct().count()
    rows = queries._stored_results(spark, sf_dir)
    report = queries.analyze_results(rows, (0, 1), "row_ord", counted=True)["outperformed"]
    assert report.agg({"n": "sum"}).first()[0] == pairs.count() and report.count() == pairs.distinct().count()
