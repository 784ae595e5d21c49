import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from textpair.llm import minhash
from textpair.llm.components import connected_components


def brute(rows):
    """Component per row by comparing all pairs of full sets."""
    sets = []
    for _, text in rows:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()]
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return sorted((d, len(sets[i]), min(groups[find(i)])) for i, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    base = [rng.choice(vocabulary) for _ in range(220)]
    # A large group of near copies, some too far from the base but near to others.
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    # A chain: each differs from the one before in the next words.
    words = [rng.choice(vocabulary) for _ in range(200)]
    for i in range(12):
        words = list(words)
        words[i * 15] = "chain"
        rows.append(" ".join(words))
    rows += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    rows += [rows[0].upper(), "a b", "A  b", "\t ", "", None, "a b c d", "é è", "É è"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(5)
    got = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nulls_repeats_and_empty_table(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None), (None, "q r"), (9, long), (3, long + " y")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], key=str) == sorted([
        (None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (None, 0, None, True), (None, 1, None, True),
        (9, 29_996, 3, False), (3, 29_997, 3, True),
    ], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(70, 71), (71, 70), (5, 5)]
    roots = connected_components(spark.createDataFrame(edges, "u long, v long"))
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {70: 70, 71: 70}
    assert {r.node: r.root for r in roots.collect()} == want
    assert roots.count() == len(want)


def test_blocks_of_large_clusters(spark, monkeypatch):
    """Clusters of several blocks give the same components."""
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 16)
    rows = corpus()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_both_ways_of_intersecting_agree():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 150).astype(np.uint64)) for _ in range(30)]
    pairs = np.argwhere(np.triu(np.ones((30, 30), bool), 1))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in pairs]
    assert minhash.intersections(sets, pairs).tolist() == want
    assert minhash.intersections(sets, pairs[:50]).tolist() == want[:50]


def test_deduplicated_keeps_one_of_each(spark):
    long = " ".join(f"x{i}" for i in range(200))
    rows = [(4, long, "a"), (2, long + " y", "b"), (9, "other words", "c"), (9, "other words", "c"), (None, "no id", "d"), (7, None, "e"), (8, None, "e"), (None, long, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = minhash.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted([rows[1], rows[2], rows[4], rows[5], rows[6]], key=str)


def between(rng, shared, own):
    """Two texts with ``shared`` equal and ``own`` different shingles each."""
    common = [f"c{rng.randrange(10**9)}" for _ in range(shared + 4)]
    return [" ".join([*common, *[f"t{rng.randrange(10**9)}" for _ in range(own)]]) for _ in range(2)]


def test_pipeline_stage_links_from_eighty_percent(spark):
    """Pairs of 0.80 and a little more are linked by the stage, those below are not; op9's own bound stays."""
    rng = random.Random(11)
    pairs = [(80, 10), (81, 10), (84, 10), (164, 20), (168, 20), (79, 10), (158, 20), (60, 10)] * 8
    rows = list(enumerate(t for shared, own in pairs for t in between(rng, shared, own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    linked = [100 * shared >= 80 * (shared + 2 * own) for shared, own in pairs]
    assert kept == {2 * i for i in range(len(pairs))} | {2 * i + 1 for i, near in enumerate(linked) if not near}
    assert all(r.kept for r in minhash.near_duplicates(docs).collect())


def test_stage_equals_brute_force_at_eighty_percent(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = minhash.near_duplicates(docs, corpus_pipeline.NEAR_DUPLICATE_PERCENT).collect()
    want = brute_at(rows, 80)
    assert sorted((r.doc_id, r.component_id) for r in got) == want
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == {component for _, component in want}


def brute_at(rows, percent):
    """Component per row by comparing all pairs of full sets at any percentage."""
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    component = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and component[i] != component[j] and 100 * len(a & b) >= percent * len(a | b):
                old, new = component[i], component[j]
                component = [new if c == old else c for c in component]
    least = {}
    for (doc_id, _), c in zip(rows, component, strict=True):
        least[c] = min(doc_id, least.get(c, doc_id))
    return sorted((doc_id, least[c]) for (doc_id, _), c in zip(rows, component, strict=True))


def test_bands_follow_from_the_percentage():
    assert minhash.bands_for(85) == minhash.Bands(85, 32, 6, 139)
    for percent in (50, 70, 80, 90, 95):
        bands = minhash.bands_for(percent)
        assert bands.minima <= minhash.MINIMA and (1 - (percent / 100) ** bands.rows) ** bands.count <= 1e-6


def near_texts(spark_rows=None):
    """A, N and C: both ends within 0.85 of the middle, not of each other."""
    words = [f"w{i}" for i in range(120)]
    middle = list(words)
    a, c = list(words), list(words)
    a[:8] = [f"a{i}" for i in range(8)]
    c[-8:] = [f"c{i}" for i in range(8)]
    return " ".join(a), " ".join(middle), " ".join(c)


def test_rows_without_an_id_link_others(spark):
    a, n, c = near_texts()
    rows = [(1, a), (None, n), (None, n), (2, c), (None, "one two three four five six"), (None, "one two three four five six seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = minhash.near_duplicates(docs, 80).collect()
    by_text = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by_text[1, 116] == by_text[2, 116] == by_text[None, 116] == 1
    kept = [(r.doc_id, r.text) for r in minhash.deduplicated(docs, 80).collect()]
    assert (1, a) in kept and len([k for k in kept if k[1] in (a, n, c)]) == 1


def test_one_row_stays_of_a_component_within_one_id(spark):
    a, n, c = near_texts()
    docs = spark.createDataFrame([(5, a), (5, n), (5, c), (5, n), (5, ""), (5, ""), (6, None)], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in minhash.deduplicated(docs, 80).collect()]
    assert len(kept) == 3 and {(5, ""), (6, None)} < set(kept)
