import time

import numpy as np

from textpair.functions.rouge import SCORE_COLUMNS
from textpair.operators import dominance

SCHEMA = "model string, target_query string, generated_output string, " + ", ".join(f"{c} double" for c in SCORE_COLUMNS)


def test_bitmaps_count_pairs():
    rng = np.random.default_rng(1)
    for size_a, size_b in ((0, 5), (5, 0), (1, 1), (300, 77), (1500, 2000)):
        a, b = rng.integers(0, 12, (size_a, 4)) / 4, rng.integers(0, 12, (size_b, 4)) / 4
        times = rng.integers(1, 40, size_b)
        want = [(times * (x > b).all(axis=1)).sum() for x in a]
        assert dominance.beaten(a, b, times).tolist() == want


def brute(rows, first, second):
    out = {}
    for model, target, output, *scores in rows:
        if model == first:
            wins = sum(
                m == second and t == target and all(x > y for x, y in zip(scores, s, strict=True)) for m, t, _, *s in rows
            )
            if wins:
                n = out.get((target, output), (0, 0))[0] + 1
                out[target, output] = (n, wins)
    return out


def counted(df, *args, **options):
    rows = dominance.outperformed_counts(df, *args, **options).collect()
    found = {(r["target_query"], r["generated_output"]): (r["n"], r["wins"]) for r in rows}
    assert len(found) == len(rows)
    return found


def table(rng, n, targets):
    rows = []
    for i in range(n):
        output = int(rng.integers(0, 60))
        target = targets[int(rng.integers(0, len(targets)))]
        model = ["x", "y", "z"][int(rng.integers(0, 3))]
        scores = np.random.default_rng([output, len(target or "")]).integers(0, 6, 4) * 20.0
        rows.append((model, target, f"o{output}", *map(float, scores)))
    return rows


def test_equals_brute_force_joined_and_tiled(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = table(rng, 900, ["t", "tt", None, "", "rare"] + ["t"] * 6) + [("x", "t", "nan", 100.0, float("nan"), 100.0, 100.0), ("y", "t", "null", 0.0, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    plain = [r for r in rows if r[2] not in ("nan", "null")]
    want = brute(plain, "x", "y")
    assert counted(df, "x", "y") == want
    # Every target through tiles, several for each.
    monkeypatch.setattr(dominance, "FEW_PAIRS", 0)
    monkeypatch.setattr(dominance, "TILE", 16)
    assert counted(df, "x", "y") == want
    assert counted(df, "x", "y", null_safe=False) == {k: v for k, v in want.items() if k[0] is not None}
    assert counted(df.where("false"), "x", "y") == {}


def test_one_target_with_many_distinct_outputs(spark):
    """10^5 outputs on each side, 10^10 pairs: tiles count them, nothing lists them."""
    n = 100_000
    mixed = [f"cast(pmod(xxhash64(id, {k}), 10001) AS double) / 100" for k in range(4)]
    first = spark.range(n).selectExpr("'x' AS model", "'t' AS target_query", "concat('a', id) AS generated_output", *[f"{m} AS {c}" for m, c in zip(mixed, SCORE_COLUMNS, strict=True)])
    second = spark.range(n, 2 * n).selectExpr("'y' AS model", "'t' AS target_query", "concat('b', id) AS generated_output", *[f"{m} AS {c}" for m, c in zip(mixed, SCORE_COLUMNS, strict=True)])
    df = first.union(second)
    start = time.time()
    got = dominance.outperformed_counts(df, "x", "y").collect()
    assert time.time() - start < 240
    a = {r["generated_output"]: [r[c] for c in SCORE_COLUMNS] for r in first.where("generated_output IN ('a7', 'a50', 'a99999')").collect()}
    b = np.array([[r[c] for c in SCORE_COLUMNS] for r in second.collect()])
    wins = {r["generated_output"]: r["wins"] for r in got}
    for output, scores in a.items():
        assert wins.get(output, 0) == int((np.array(scores) > b).all(axis=1).sum())
    assert len(got) > 0.9 * n


def test_rows_are_computed_once(spark):
    """Both sides, and every step of the counting, read one aggregate: no pass over the rows for each of them."""
    from pyspark.sql import functions as F

    from textpair.operators import compare

    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def watched(texts):
        seen.add(len(texts))
        return texts

    rows = [("ab"[i % 2], f"t{i % 7}", f"o{i % 5}", *[float(10 + i % 9 + 5 * (i % 2 == 0))] * 4) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("generated_output", watched("generated_output"))
    plain = spark.createDataFrame(rows, SCHEMA)
    assert sorted(compare.outperformed_rows(df, "a", "b").collect()) == sorted(
        (t, o, p) for m, t, o, *s in rows for k, u, p, *r in rows
        if m == "a" and k == "b" and t == u and all(x > y for x, y in zip(s, r, strict=True))
    )
    assert seen.value == 400
    wins = sorted(dominance.outperformed_counts(df, "a", "b").collect())
    assert wins and wins == sorted(dominance.outperformed_counts(plain, "a", "b").collect())
    assert seen.value == 800
