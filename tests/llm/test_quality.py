import random

import numpy as np

from textpair.llm import quality as q


def rows(n=400):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("an", "el", "ior", "um", "ast")]
    docs, labels = [], []
    for i in range(n):
        picked = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        good = rng.random() < 0.7
        if not good:
            picked = [w.upper() + "!!" for w in picked] if i % 2 else [w + rng.choice(("$$$", "&&&", "###")) for w in picked]
        docs.append((i, " ".join(picked)))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = rows()
    clean = [t for (_, t), (_, good) in zip(docs, labels, strict=True) if good]
    edge = [(900, None), (901, ""), (902, " ".join(clean * 10)), (None, "lan del mior"), (3, "lan del"), (3, "lan del")]
    table = spark.createDataFrame(docs + edge, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS label").repartition(4)
    marked = spark.createDataFrame([*labels, (900, None), (901, 0), (901, 1), (None, 1)], "doc_id long, quality int")
    got = q.assess(table, marked).collect()
    assert len(got) == len(docs) + len(edge)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= q.THRESHOLD) for r in got)
    found, truth = {r.doc_id: r for r in got}, dict(labels)
    held = [d for d in truth if found[d].held_out and d != 3]
    assert len(held) > 40 and sum(found[d].predicted == truth[d] for d in held) >= 0.95 * len(held)
    assert found[None].held_out is False and found[900].score == found[901].score and found[902].predicted == 1


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in q.assess(docs, none).collect()] == [0.5]
    assert q.assess(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


def test_blocks_are_the_whole_text_and_do_not_change_pooling(monkeypatch):
    text = "aa Bb!! cc cc 12 " * 50
    numbers = q.TokenNumbers(q.SHAPES)
    vectors = np.random.default_rng(0).normal(size=(len(q.SHAPES), q.DIMENSIONS)).astype(np.float32)
    whole = q.pooled(text, numbers, vectors)
    monkeypatch.setattr(q, "BLOCK_CHARS", 40)
    assert "".join(q.blocks(text)) == text and len(list(q.blocks(text))) > 10
    assert np.allclose(q.pooled(text, numbers, vectors), whole, atol=1e-5)


def test_temperature_lowers_the_log_loss():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=2000)
    labels = (rng.random(2000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert 2 < q.fit_temperature(logits * 3, labels) < 4.5
