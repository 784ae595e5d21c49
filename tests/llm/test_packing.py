import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from textpair.llm import packing
from textpair.llm.catalog import LLM_QUERIES

TEXTS = [
    "", None, " ", "Hello  world", "a b\nc d", "one\n two", "tabs\t\there ", " lead", "l'été déjà vu — ok", "x" * 5000, "naïve " * 3000,
    "it's 42 (really)\r\n\r\nyes", "<|endoftext|> is text", "emoji 😀 ok", " nbsp  x", "a b c",
]


def rows():
    sources = ["a"] * 8 + ["b"] * 4 + [None] * 3 + ["tiny"]
    return [(i, TEXTS[i % len(TEXTS)], sources[i % len(sources)]) for i in range(64)] + [(3, TEXTS[3], "a"), (None, "no id", "z")]


def expected_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def check(pieces, data, length):
    ids = {i: x for i, x in zip([r[0] for r in data], expected_ids([r[1] for r in data]), strict=True)}
    copies = Counter(r[0] for r in data)
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.length > 0
        part = np.array(own[p.start : p.start + p.length], "<u4").tobytes()
        assert len(part) == 4 * p.length and zlib.crc32(part) == p.ids_crc32
        by_doc[p.doc_id] += range(p.start, p.start + p.length)
        by_window[p.sequence_id].append((p.offset, p.length))
    for doc_id, own in ids.items():
        assert Counter(by_doc[doc_id]) == {i: copies[doc_id] for i in range(len(own))}
    sizes = []
    for window in sorted(by_window):
        at = 0
        for offset, n in sorted(by_window[window]):
            assert offset == at
            at += n
        sizes.append(at)
    assert sorted(by_window) == list(range(len(sizes)))
    assert all(n == length for n in sizes[:-1]) and 0 < sizes[-1] <= length


def test_every_id_once_and_windows_full(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(7)
    for length in (1024, 64, 7):
        check(packing.pack(docs, length).collect(), data, length)


def test_windows_hold_the_mixture(spark):
    data = [(i, "word " * (20 + i % 9), "abc"[min(i % 7, 2)]) for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    pieces = packing.pack(docs, 128).collect()
    source = {r[0]: r[2] for r in data}
    total = Counter()
    windows = defaultdict(Counter)
    for p in pieces:
        windows[p.sequence_id][source[p.doc_id]] += p.length
        total[source[p.doc_id]] += p.length
    everything = sum(total.values())
    for w in sorted(windows)[:-1]:
        for s in "abc":
            assert abs(windows[w][s] - 128 * total[s] / everything) <= 2
    assert max(p.padded_length for p in pieces) == 128


def mixed(spark, sizes, targets, length, parts=5):
    """Pieces by window of sources with that many tokens, and the number of tokens."""
    data = []
    for source, n in sizes.items():
        while n:
            own = min(n, 5 + len(data) % 60)
            data.append((len(data), "word " * (own - 2) + "word" if own > 1 else "", source))
            n -= own
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(parts)
    pieces = packing.pack(docs, length, targets=targets).collect()
    check(pieces, data, length)
    source = {r[0]: r[2] for r in data}
    windows = defaultdict(Counter)
    for p in pieces:
        windows[p.sequence_id][source[p.doc_id]] += p.length
    return [windows[w] for w in sorted(windows)]


def test_targets_hold_until_a_queue_is_dry(spark):
    """Half and half until b ends, then a alone with what no target names; deficits never grow."""
    windows = mixed(spark, {"a": 6000, "b": 1200, "c": 900}, {"a": 0.5, "b": 0.3}, 100)
    for w in range(40):  # b lasts 1200 / 30 windows
        seen = sum(windows[: w + 1], Counter())
        for source, share in (("a", 50), ("b", 30), ("c", 20)):
            assert abs(seen[source] - share * (w + 1)) <= 1 and abs(windows[w][source] - share) <= 1
    for w in range(41, 45):  # c has 100 left, which last 100 / (100 * 2 / 7) windows
        if w < 43:
            assert abs(windows[w]["a"] - 500 / 7) <= 2 and abs(windows[w]["c"] - 200 / 7) <= 2
    assert all(w["a"] == 100 for w in windows[45:-1])


def test_sources_without_share_come_last(spark):
    windows = mixed(spark, {"a": 700, None: 700, "z": 500, "y": 300}, {"a": 0.5, None: 0.5}, 64)
    assert all(w["a"] == w[None] == 32 for w in windows[:21])
    assert sum(w["z"] + w["y"] for w in windows[22:]) == sum(map(Counter.total, windows[22:]))


def test_targets_over_many_phases_and_sizes(spark):
    sizes = {chr(97 + i): 40 + 37 * i * i for i in range(9)}
    for length in (16, 1024):
        windows = mixed(spark, sizes, {s: 1 / 16 for s in list(sizes)[:8]}, length, 3)
        assert sum(windows, Counter()) == sizes
    mixed(spark, {"a": 30, "b": 2000}, {"a": 0.9, "not there": 0.05}, 64)


def phases_by_steps(sizes, shares, steps):
    """The definition in small steps: all queues that are not dry earn credit by their shares."""
    rest, sent = [float(n) for n in sizes], 0.0
    ends = {}
    while any(n > 0 for n in rest):
        alive = [i for i, n in enumerate(rest) if n > 0 and shares[i]] or [i for i, n in enumerate(rest) if n > 0]
        weight = {i: float(shares[i]) or rest[i] for i in alive}
        for i in alive:
            rest[i] -= weight[i] / sum(weight.values()) / steps
            if rest[i] <= 1e-9:
                rest[i] = 0.0
                ends[i] = sent
        sent += 1 / steps
    return ends


def test_phases_end_where_queues_run_dry():
    sizes, shares = [40, 10, 25, 5], [Fraction(1, 2), Fraction(1, 4), Fraction(1, 4), Fraction(0)]
    plan = packing.phases(sizes, shares)
    assert [sum(x) for x in zip(*[sent for _, sent in plan])] == sizes
    assert [begin for begin, _ in plan] == [0, *np.cumsum([sum(sent) for _, sent in plan])[:-1]]
    ends = phases_by_steps(sizes, shares, 200)
    for i, size in enumerate(sizes):
        last = max(k for k, (_, sent) in enumerate(plan) if sent[i])
        assert abs(plan[last][0] + sum(plan[last][1]) - ends[i]) <= len(sizes)


@pytest.mark.parametrize("targets", [{"a": 0.7, "b": 0.4}, {"a": 0.001}, {"a": 0.9995}, {"a": -0.1}])
def test_targets_that_no_window_can_hold_raise(targets):
    with pytest.raises(ValueError, match="target share"):
        packing.target_shares(targets, 100)


def test_one_document_and_empty_table(spark):
    schema = "doc_id long, text string, source string"
    (piece,) = packing.pack(spark.createDataFrame([(1, "", None)], schema)).collect()
    assert (piece.length, piece.sequence_id, piece.offset, piece.padded_length) == (1, 0, 0, 1)
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0


def test_closed_form_is_exact_beyond_64_bits():
    everything, own, low = 3 * 10**13 + 7, 10**13 + 3, 5 * 10**12 + 1
    at = own - 5000
    windows, starts, lengths, offsets = packing.cut_document(at, 5000, low, own, everything, 1024)
    assert lengths.sum() == 5000 and starts[0] == 0 and (starts[1:] == np.cumsum(lengths)[:-1]).all()
    assert (offsets >= 0).all() and (offsets + lengths <= 1024).all()


SPECIALS = [
    "<|endoftext|> is text", "<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>  b\n<|endoftext|><|endoftext|>c", "<|endoftext<|endoftext|>|>",
    "<|ENDOFTEXT|> <|endoftext |>", "é<|endoftext|>é  x", None, "none here",
]


def contract_ids(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_query_and_stage_give_special_strings_their_id(spark, tmp_path):
    """Ids as the tokenizers library gives them with add_special_tokens=False."""
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(SPECIALS)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert contract_ids(SPECIALS[0]) == [50256, 318, 2420, 0]
    for pieces in (LLM_QUERIES["op6_packing"](spark, str(tmp_path)), corpus_pipeline.packing_stage(spark, docs, str(tmp_path))):
        found = {p.doc_id: p for p in pieces.collect()}
        for i, text in enumerate(SPECIALS):
            own = contract_ids(text)
            assert (found[i].start, found[i].length, found[i].doc_tokens) == (0, len(own), len(own))
            assert found[i].ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())


def test_a_text_is_read_in_one_call():
    """One call of the reader for each part between special tokens, whatever the number of words."""
    encode, calls = packing.encoder(packing.public_tokenizers.path(packing.RANKS)), []

    def counted(text):
        calls.append(text)
        return encode(text)

    text = "the quick  brown fox\n jumps, the 12 dogs' été " * 50
    assert np.frombuffer(packing.token_ids(text, counted), "<u2").tolist() == encode(text) and calls == [text]
    parts = packing.special_ids(f"a b{packing.SPECIAL}c d", counted)
    assert np.frombuffer(parts, "<u2").tolist() == [*encode("a b"), packing.SPECIAL_ID, *encode("c d")] and calls[1:] == ["a b", "c d"]
