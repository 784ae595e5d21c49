import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from textpair.operators import subwords, vocab

FILE = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def words(spark):
    return subwords.Subwords(spark, FILE)


@pytest.fixture(scope="module")
def reader(words):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=words.table.value, special_tokens={})


def naive(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_equal_one_at_a_time(words):
    rng = random.Random(1)
    ranks = words.table.value
    for _ in range(500):
        piece = "".join(rng.choice("aabcdethn iosé日😀 '") for _ in range(rng.randrange(1, 30))).encode()
        assert subwords.merged(piece, ranks) == (naive(piece, ranks) if piece not in ranks else [ranks[piece]])
    assert len(subwords.merged(b"ab" * 50_000, ranks)) > 1


TEXTS = [
    None, "", " ", "a", "Hello world", "it's we'll  two  spaces\n\n and\tlines \n", "x y z\x1cq\x85 w", "日本語 12345 ½ ² Ⅷ", "😀😀 naïve",
    "a" * 3000, " " * 500 + "b", "!!!...???", "'s 't 'S 'LL", "don’t", "\r\n\r\n x", "é ñ",
]


def test_ids_and_round_trip(spark, words, reader):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("aeiou tnsr  \n.,'é1ñ日\t") for _ in range(rng.randrange(200))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "product_id int, t string").repartition(4)
    made = df.select("product_id", subwords.subword_ids("t", words).alias("ids"))
    ids = {r["product_id"]: r["ids"] for r in made.collect()}
    assert ids == {i: reader.encode_ordinary(x or "") for i, x in enumerate(texts)}
    back = {r["product_id"]: r["text"] for r in subwords.decode_subwords(made, words, "ids").collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}


def test_encode_cuts_and_closes(spark, words, reader):
    rows = [(1, "word " * 600, "a b c " * 20), (1, None, ""), (None, "x", None)]
    df = spark.createDataFrame(rows, "product_id int, input_text string, short_query string")
    got = subwords.encode_subwords(df, words).collect()
    assert len(got) == 3 and {len(r["input_ids"]) for r in got} == {512, 1, 2}
    for r in got:
        assert r["input_ids"][-1] == r["labels"][-1] == words.eos == 50256 and r["attention_mask"] == [1] * len(r["input_ids"])
    assert max(len(r["labels"]) for r in got) == 30
    decoded = spark.createDataFrame([(1, [50256, -100, 64, None, 64]), (2, None), (3, [222])], "product_id int, labels array<int>")
    assert [r["text"] for r in subwords.decode_subwords(decoded, words).orderBy("product_id").collect()] == ["aa", "", "�"]


def test_nothing_is_shuffled(spark, words):
    df = spark.createDataFrame([(1, "a", "b")], "product_id int, input_text string, short_query string")
    for plan in (subwords.encode_subwords(df, words), vocab.encode_tokens(df, vocab.build_vocab(df, ["input_text"], 10))):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert subwords.encode_subwords(df.where("false"), words).collect() == []


def test_files_are_checked(spark, tmp_path):
    path = tmp_path / "ranks"
    path.write_text("YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError, match="every byte"):
        subwords.Subwords(spark, str(path))


def test_large_vocabularies_are_joined(spark, monkeypatch):
    rows = [(1, "b b a", "c"), (2, None, "a zzz"), (2, "", "b"), (None, "a " * 700, "c " * 50)]
    df = spark.createDataFrame(rows, "product_id int, input_text string, short_query string")
    words = vocab.build_vocab(df, ["input_text"], 100)

    def ways():
        encoded = vocab.encode_tokens(df, words)
        decoded = vocab.decode_tokens(encoded, words, "input_ids")
        return sorted(map(str, encoded.collect())), sorted(map(str, decoded.collect())), encoded

    sent = ways()
    monkeypatch.setattr(vocab, "MOST_TOKENS", 2)
    joined = ways()
    assert sent[:2] == joined[:2]
    assert "Exchange" in joined[2]._jdf.queryExecution().executedPlan().toString()
    assert joined[2].where(F.size("input_ids") == 512).count() == 1


def test_batches_and_writers_are_bounded(spark, sf_dir):
    """Python gets few rows at once, whatever a partition holds, and writing by model sorts nothing."""
    from textpair.catalog.queries import QUERIES

    kept = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.maxConcurrentOutputFileWriters")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "0")
        QUERIES["encode_subwords"](spark, sf_dir)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
        assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) >= 3
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_short_merges_and_joined_bytes(words):
    import pyarrow as pa

    rng, ranks = random.Random(3), words.table.value
    for _ in range(300):
        piece = "".join(rng.choice("aeiou tnsrñ日") for _ in range(rng.randrange(1, 40))).encode()
        assert subwords.merged_short(piece, ranks) == naive(piece, ranks)
    lists = pa.array([[ranks[b"a"], -100, None, 10**6], None, [], [ranks[b"b"]], [ranks["é".encode()[:1]]]], pa.list_(pa.int32()))
    tokens = subwords.tokens_by_id(words.table)
    assert subwords.joined(lists, tokens) == ["a", "", "", "b", "�"]
    assert subwords.joined(lists.slice(2, 2), tokens) == ["", "b"] and subwords.joined(lists[:0], tokens) == []
