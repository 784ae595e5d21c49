import re
from collections import defaultdict

from textpair.llm import mixing


def targets(sizes):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    goal, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[n] for n in open_)
        over = [n for n in open_ if level * weight[n] > 2 * sizes[n]]
        if not over:
            goal.update({n: level * weight[n] for n in open_})
            break
        for n in over:
            goal[n] = 2 * sizes[n]
            left -= goal[n]
            open_.remove(n)
    return goal


def rows():
    out = []
    for i in range(300):
        source = ["b", "a", None, "Z", "é", "tiny"][min(i % 11, 5)] if i % 17 else "hot"
        out.append((i, " \t".join(["w"] * (i * 7 % 40)) if i % 13 else None, source))
    return out + [(1, "w w", "b"), (1, "w w", "b"), (None, "no id", "a"), (900, "", "empty"), (901, "long " * 20_000, "hot")]


SCHEMA = "doc_id long, text string, source string"


def test_shares(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = mixing.shares(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in data:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    goal = targets(sizes)
    assert len(got) == len(data)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for source in sizes:
        assert goal[source] - 1 < taken[source] <= goal[source] + 1e-6
    again = mixing.shares(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_agrees_with_shares_and_interleaves(spark):
    data = [r for r in rows() if r[0] is not None]
    docs = spark.createDataFrame(data, SCHEMA).selectExpr("*", "0L AS n_chars", "'x' AS _hash", "'y' AS _size")
    want = defaultdict(int)
    for r in mixing.shares(docs).collect():
        want[r.doc_id] += r.taken
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = defaultdict(int)
    listed = mixed.collect()
    for r in listed:
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and r._hash == "x"
    assert {d: n for d, n in want.items() if n} == dict(got)
    # Any first half of the mix holds about half of every large source's words.
    total, half = defaultdict(int), defaultdict(int)
    for i, r in enumerate(listed):
        if r.doc_id != 901:
            total[r.source] += len(r.text.split())
            half[r.source] += len(r.text.split()) * (i < len(listed) / 2)
    assert all(0.3 < half[s] / n < 0.7 for s, n in total.items() if n > 1000)


def test_empty_tables(spark):
    for data in ([], [(1, None, "a"), (2, "", None)]):
        docs = spark.createDataFrame(data, SCHEMA)
        assert [r.taken for r in mixing.shares(docs).collect()] == [0] * len(data)
        assert mixing.mix(docs).count() == 0
