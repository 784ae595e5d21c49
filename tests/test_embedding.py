import re

import numpy as np
import pyarrow as pa
import pytest

from textpair.catalog import tables
from textpair.operators import embedding, similarity

COLS = ["title", "description"]


def brute_pairs(texts, vocabulary, reach):
    """Dense weighted counts, pair by pair."""
    place = {t: i for i, t in enumerate(vocabulary)}
    counts = np.zeros((len(place), len(place)))
    for text in texts:
        tokens = re.sub("[^a-z0-9]+", " ", (text or "").lower()).split()
        for i, x in enumerate(tokens):
            for d, weight in enumerate(embedding.weights(reach), 1):
                if i + d < len(tokens) and x in place and tokens[i + d] in place:
                    a, b = place[x], place[tokens[i + d]]
                    counts[a, b] += weight
                    if a != b:
                        counts[b, a] += weight
    return counts


def brute_information(counts):
    sums = counts.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.log(counts * sums.sum() / np.outer(sums, sums))
    return np.where(counts > 0, np.maximum(v, 0), 0)


def brute_eigenvectors(m, dimensions):
    """The same range finder over a dense matrix."""
    basis = np.random.default_rng(embedding.SEED).standard_normal((len(m), dimensions + embedding.OVERSAMPLING))
    for _ in range(embedding.PASSES):
        basis = np.linalg.qr(m @ basis)[0]
    values, vectors = np.linalg.eigh(basis.T @ m @ basis)
    order = sorted(range(len(values)), key=lambda i: -abs(values[i]))[:dimensions]
    found = [basis @ vectors[:, i] * abs(values[i]) ** 0.5 for i in order]
    return np.array([f if f[np.abs(f).argmax()] > 0 else -f for f in found]).T


def dense(matrix, n):
    out = np.zeros((n, n))
    for r in matrix.collect():
        out[r.a, r.b] = r.v
    return out


@pytest.fixture(scope="module")
def products(spark, sf_dir):
    return tables.products(spark, sf_dir)


def test_vectors_equal_numpy(spark, products):
    """Counts, information and eigenvectors against dense ones on the smallest tables."""
    size, dimensions = 400, 64
    words = [r.token for r in embedding.word_counts(products, COLS, size).collect()]
    import pyarrow as pa

    entries = spark.sparkContext.broadcast((pa.array(words), pa.array(range(size), pa.int32())))
    pairs = embedding.cooccurrences(products, COLS, entries)
    counts = brute_pairs([r[c] for r in products.collect() for c in COLS], words, embedding.REACH)
    assert {(r.a, r.b): r.w for r in pairs.collect()} == {(a, b): counts[a, b] for a, b in zip(*np.nonzero(np.triu(counts)))}
    matrix = embedding.information(pairs)
    want = brute_information(counts)
    assert np.allclose(dense(matrix, size), want, atol=1e-9)

    basis = np.random.default_rng(1).standard_normal((size, 10))
    assert np.allclose(embedding.times(matrix, basis), want @ basis)
    vectors = embedding.eigenvectors(matrix, size, dimensions)
    assert np.allclose(vectors, brute_eigenvectors(want, dimensions), atol=1e-6)
    # The range finder against the exact decomposition: the four that stand out agree, and the rest of a flat spectrum nearly.
    values, own = np.linalg.eigh(want)
    top = np.argsort(-np.abs(values))[:dimensions]
    signs = np.sign(np.einsum("id,ij,jd->d", vectors, want, vectors))
    best = np.linalg.norm(want - own[:, top] * values[top] @ own[:, top].T)
    assert np.linalg.norm(want - vectors * signs @ vectors.T) <= 1.15 * best
    assert np.allclose(np.linalg.norm(vectors, axis=0)[:4] ** 2, np.abs(values[top][:4]), rtol=1e-3)


def test_texts_without_a_common_word_can_be_alike(spark):
    rng = np.random.default_rng(2)
    topics = [["cat", "dog", "fur", "paw", "tail", "pet"], ["loan", "bank", "rate", "debt", "fund", "bond"]]
    rows = [(i, " ".join(rng.choice(topics[i % 2], 8))) for i in range(400)]
    df = spark.createDataFrame(rows, "product_id int, t string")
    embedder = embedding.learn_embedder(df, ["t"], size=12, dimensions=4, reach=5)
    pairs = [("cat dog", "fur paw"), ("loan bank", "debt bond"), ("cat dog", "debt bond"), ("", "cat"), ("zzz", "cat"), (None, "Cat!")]
    asked = spark.createDataFrame([("m", *p) for p in pairs], "model string, target_query string, generated_output string")
    got = {(r["target_query"], r["generated_output"]): r["semantic_similarity"] for r in similarity.semantic_similarity(asked, embedder=embedder).collect()}
    assert got["cat dog", "fur paw"] > 0.8 and got["loan bank", "debt bond"] > 0.8 and got["cat dog", "debt bond"] < 0.3
    assert got["", "cat"] == got["zzz", "cat"] == 0.0
    vectors = similarity.text_vectors(df, "t", embedder=embedder).collect()
    assert len(vectors) == 400 and all(len(r["vector"]) == 4 for r in vectors)


def test_empty_and_too_large(spark):
    empty = spark.createDataFrame([], "product_id int, t string")
    embedder = embedding.learn_embedder(empty, ["t"], dimensions=8)
    df = spark.createDataFrame([(1, "x y")], "product_id int, t string")
    assert similarity.text_vectors(df, "t", embedder=embedder).first()["vector"] == [0.0] * 8
    with pytest.raises(ValueError, match="cells"):
        embedding.eigenvectors(df, 1_000_000, 512)


def test_texts_are_counted_once(spark, sf_dir):
    """What ``word_information`` reduces is a stored table: no text is read again."""
    from textpair.catalog.queries import QUERIES

    plan = QUERIES["word_information"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "documents" not in plan
    learned = QUERIES["semantic_similarity_learned"](spark, sf_dir)
    assert "_counts" not in learned._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_the_same_in_a_square_by_sorting_and_in_parts(spark, monkeypatch):
    """Both ways of counting, with few and with many tokens at once, agree with counting one by one."""
    texts = ["a b a c b a", "", "z z a", "b " * 30 + "c", "a"]
    words = ["a", "b", "c"]
    lists = pa.array([t.split() for t in texts], pa.list_(pa.string()))
    near = embedding.weights(5)

    class Sent:
        value = (pa.array(words), pa.array(range(3), pa.int32()))

    want = brute_pairs(texts, words, 5)
    for square, tokens, pairs in ((1 << 22, 1 << 18, 1 << 20), (0, 1 << 18, 1 << 20), (0, 4, 2), (1 << 22, 4, 2)):
        monkeypatch.setattr(embedding, "MOST_SQUARE", square)
        monkeypatch.setattr(embedding, "HELD_TOKENS", tokens)
        monkeypatch.setattr(embedding, "HELD_PAIRS", pairs)
        got = np.zeros((3, 3))
        for batch in embedding._count_pairs(Sent, near)(iter([pa.RecordBatch.from_arrays([lists], names=["_tokens"])])):
            for r in batch.to_pylist():
                got[r["a"], r["b"]] += r["w"]
                if r["a"] != r["b"]:
                    got[r["b"], r["a"]] += r["w"]
        assert (got == want).all()
    assert max(map(len, embedding._parts(lists))) <= 4 and sum(map(len, embedding._parts(lists))) == len(lists)


def test_texts_are_cut_once_and_looked_up_in_one_python_step(spark, products):
    """The pairs' plan has one Python step, and it reads stored tokens, not the products."""
    texts = embedding._stored_token_rows(products, COLS)
    entries = spark.sparkContext.broadcast((pa.array(["the"]), pa.array([0], pa.int32())))
    plan = embedding._paired(texts, entries, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "regexp" not in plan
    rows = [r[0] for r in embedding._token_rows(products, COLS).collect()]
    assert sorted(rows) == sorted(r[0] for r in texts.collect())
