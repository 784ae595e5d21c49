import random

from pyspark.sql import functions as F

from textpair.llm import hamming_search as hs


def brute(rows, k):
    valid = [(i, [x > 0 for x in v]) for i, v in rows if i is not None and v is not None and None not in v]
    out = []
    for q, a in valid:
        if q % 20 == 0:
            near = sorted((sum(x != y for x, y in zip(a, b)), i) for i, b in valid if i != q)[:k]
            out += [(q, rank, i, d) for rank, (d, i) in enumerate(near, 1)]
    return sorted(out)


def check(spark, rows, k):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit(1)).repartition(5)
    got = hs.nearest(vectors, F.col("vec_id") % 20 == 0, k)
    assert sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in got.collect()) == brute(rows, k)


def test_equals_brute_force_with_copies_and_clusters(spark):
    rng = random.Random(3)
    centers = [[rng.choice((-1.0, 1.0)) for _ in range(64)] for _ in range(4)]
    rows = []
    for i in range(400):
        v = list(centers[i % 4])
        for _ in range(rng.randrange(0, 9)):
            v[rng.randrange(64)] *= -1
        rows.append((i, v))
    rows += [(1000 + i, centers[0]) for i in range(60)] + [(5000, None), (5020, [None] * 64), (None, centers[1]), (6000, [0.0] * 64)]
    check(spark, rows, 5)


def test_few_rows_fewer_neighbours_and_empty(spark):
    check(spark, [(0, [1.0] * 64), (1, [-1.0] * 64), (20, [1.0] * 63 + [-1.0])], 10)
    assert hs.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_segments_follow_the_number_of_codes():
    for total, widths in ((0, [1] * 64), (1, [1] * 64), (500, [8] * 8), (10_000, [13] * 4 + [12]), (50_000, [13] * 4 + [12]), (10**9, [22, 21, 21])):
        assert hs.segment_widths(total) == widths and sum(widths) == 64


def test_every_size_goes_through_the_index_and_verifies_few_pairs(spark, monkeypatch):
    """No size of table takes another path, and most pairs of query and code are never let through."""
    verified = []
    plain = hs.looked_up

    def counted(*args):
        pairs = plain(*args)
        rows = [(r.query, r.code) for r in pairs.collect()]
        verified.extend(rows)
        return pairs

    monkeypatch.setattr(hs, "looked_up", counted)
    rng = random.Random(5)
    for n in (1, 30, 1200):
        verified.clear()
        rows = [(i, [rng.choice((-1.0, 1.0)) for _ in range(64)]) for i in range(n)]
        check(spark, rows, 3)
        queries = (n + 19) // 20
        assert len(verified) == len(set(verified)) >= queries
        assert n < 1000 or len(verified) <= 0.4 * queries * n


def test_far_query(spark):
    """A query far from all others needs every radius."""
    rng = random.Random(6)
    rows = [(i, [1.0] * 60 + [rng.choice((-1.0, 1.0)) for _ in range(4)]) for i in range(1, 60)] + [(0, [-1.0] * 64)]
    check(spark, rows, 4)
