import pytest
from pyspark.sql import functions as F

from textpair.catalog import tables
from textpair.operators import checkpoints
from textpair.session import shared_dir
from textpair.sources import datasets, metric_logs, results

NASTY = [
    'plain', 'blank\n\nline', 'comma, "quoted"', '""', ' lead and trail ', 'tab\tcr\r\nend', 'back\\slash "q\\"', "None",
    'été', '', None, "\\n",
]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, fmt):
    rows = [(t, t, t, "m", t, 1.5, None, 0.0, 100.0) for t in NASTY]
    df = spark.createDataFrame(rows, results.result_schema(["title"], keys=()))
    path = shared_dir(spark, f"round-trip-{fmt}")
    results.write_results(df, path, fmt)
    results.write_results(df, path, fmt)
    back = results.read_results(spark, path, ["title"], fmt, keys=())
    assert back.schema == df.schema
    twice = df.unionByName(df)
    assert back.exceptAll(twice).count() == 0 and twice.exceptAll(back).count() == 0


def test_columns_are_found_by_name(spark):
    schema = results.result_schema(["title"])
    df = spark.createDataFrame([(7, 1, "t", "in", "target", "m", "out", 1.0, 2.0, 3.0, 4.0)], schema)
    path = shared_dir(spark, "reordered")
    results.write_results(df.withColumn("extra", F.lit("x")).select("extra", *reversed(schema.names)), path, "csv")
    assert [tuple(r) for r in results.read_results(spark, path, ["title"]).collect()] == [tuple(df.first())]
    with pytest.raises(ValueError, match="description"):
        results.read_results(spark, path, ["title", "description"])


def test_headers_that_differ_raise(spark):
    schema = results.result_schema(["title"])
    df = spark.createDataFrame([(7, 1, "t", "in", "target", "m", "out", 1.0, 2.0, 3.0, 4.0)], schema)
    path = shared_dir(spark, "mixed-headers")
    results.write_results(df, path, "csv")
    results.write_results(df.select(*reversed(schema.names)), path, "csv")
    with pytest.raises(Exception, match="(?i)header"):
        results.read_results(spark, path, ["title"]).collect()


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        results.write_results(spark.range(1), "/nowhere", "xml")


def test_split_partitions_are_pruned(spark, sf_dir):
    path = shared_dir(spark, "splits")
    datasets.write_splits(tables.products(spark, sf_dir), path)
    df = datasets.load_split(spark, path, "test").select("title")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<title:string>" in plan
    sub = datasets.load_split(spark, path.rsplit("/", 1)[0], "test", path.rsplit("/", 1)[1])
    assert sub.count() == df.count() > 0


def test_profile(spark):
    df = spark.range(100).withColumn("split", F.when(F.col("id") < 10, "test").otherwise("train"))
    got = {r["split"]: (r["n_rows"], r["n_columns"], r["steps_per_epoch"]) for r in datasets.split_profile(df, 32).collect()}
    assert got == {"test": (10, 2, 1), "train": (90, 2, 2)}


def test_slices_can_be_chosen(spark):
    path = shared_dir(spark, "chosen")
    df = spark.createDataFrame([("a\nb",)], "t string")
    assert results.write_case_slices({"zeros": df, "best": df}, path, ["best"]) == [f"{path}/best"]
    assert results.read_slice(spark, f"{path}/best", df.schema).first()["t"] == "a\nb"


def test_metric_logs_append(spark, sf_dir):
    path = shared_dir(spark, "logs")
    records = tables.logs(spark, sf_dir)
    for _ in range(2):
        metric_logs.write_metric_logs(checkpoints.metrics_merge(records), checkpoints.final_metrics(records), path)
    merged = spark.read.parquet(f"{path}/evaluation_metrics")
    final = spark.read.parquet(f"{path}/final_metrics")
    assert merged.columns == ["timestamp", *metric_logs.MERGED_COLUMNS]
    assert final.columns == ["timestamp", *metric_logs.FINAL_COLUMNS]
    assert final.count() == 2 * checkpoints.final_metrics(records).count()


def test_metric_logs_as_csv(spark, sf_dir):
    path = shared_dir(spark, "csv-logs")
    records = tables.logs(spark, sf_dir)
    merged = checkpoints.metrics_merge(records)
    metric_logs.write_metric_logs(merged, checkpoints.final_metrics(records), path, fmt="csv")
    back = spark.read.option("header", "true").csv(f"{path}/evaluation_metrics")
    assert back.columns == ["timestamp", *metric_logs.MERGED_COLUMNS] and back.count() == merged.count()
    with pytest.raises(ValueError):
        metric_logs.write_metric_logs(merged, merged, path, fmt="xml")


def test_compressed_files(spark):
    """Compressed CSV files, alone or beside plain ones, give the same rows in less space; Parquet is zstd."""
    import pathlib

    rows = [(t, t, t, "m", t, 1.5, None, 0.0, 100.0) for t in NASTY] * 50
    df = spark.createDataFrame(rows, results.result_schema(["title"], keys=())).repartition(3)

    def size(path):
        return sum(p.stat().st_size for p in pathlib.Path(path.removeprefix("file:")).rglob("part-*"))

    plain, path, parquet = (shared_dir(spark, n) for n in ("plain", "compressed", "compressed-parquet"))
    results.write_results(df, plain, "csv")
    results.write_results(df, path, "csv", compression="gzip")
    assert size(path) < size(plain) / 3
    results.write_results(df, path, "csv")
    back = results.read_results(spark, path, ["title"], keys=())
    twice = df.unionByName(df)
    assert back.exceptAll(twice).count() == 0 and twice.exceptAll(back).count() == 0
    results.write_results(df, parquet)
    assert all(".zstd." in p.name for p in pathlib.Path(parquet.removeprefix("file:")).rglob("part-*"))
