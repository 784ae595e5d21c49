import random
import re
from collections import Counter

import numpy as np

from textpair.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, top):
    """Every phrase of every piece, counted one by one."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *words), a in candidates.items():
        longer = [b for (other, *w), b in candidates.items() if other == lang and len(w) > len(words)
                  and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (f[lang, *words[:k]] + f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]]))
    return {
        (lang, rank, phrase.decode(), -a, l, r, n[lang], -score)
        for lang, found in out.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1)
    }


def texts(rng, count):
    words = ["new", "york", "New", "the", "of", "é", "city", "a", "a", "in", "x-1", "日本", "\x1cz", "State", "\xa0"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b", ";"]
    return ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60))) for _ in range(count)]


def found(docs, **options):
    got = co.collocations(docs, **options).collect()
    rows = {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got}
    assert len(rows) == len(got)
    return rows


def test_equals_brute_force(spark):
    rng = random.Random(1)
    langs = ["en", "en", "en", "de", None, "und", ""]
    rows = [(i, t, rng.choice(langs)) for i, t in enumerate(texts(rng, 400))]
    rows += [(1, None, "en"), (1, "", None), (None, "...", "en"), (2, "a " * 5000, "en"), (2, "a " * 5000, "en"), (3, "b" * 500_000, "de")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS w1", "2 AS n", "3 AS phrase").repartition(5)
    assert found(docs, least=12, top=40) == brute(rows, 12, 40)
    assert found(docs) == brute(rows, 30, 2000)
    assert found(docs.where("false")) == set()


def test_tables_of_marks_only_save_work(spark):
    """With a few marks for everything, hardly anything is cut short and the counts stay the same."""
    rng = random.Random(2)
    rows = [(i, t, "en") for i, t in enumerate(texts(rng, 150))]
    want = brute(rows, 10, 2000)
    for bits in ((3, 3, 3), (5, 8, 6), (15, 16, 17)):
        assert found(spark.createDataFrame(rows, SCHEMA), least=10, bits=bits) == want


def test_marks_and_slices(spark, monkeypatch):
    values = [0, 1, 7, 8, 32767, 32768, (1 << 17) - 1, -1, 1 << 40]
    table = co.marks(spark.createDataFrame([(v,) for v in values], "hash long"), 17)
    places = np.arange(1 << 17, dtype=np.uint64)
    assert set(places[co.is_marked(table, places)].tolist()) == {v & ((1 << 17) - 1) for v in values}
    text = "Ab cd.ef\tgh " * 50 + "x" * 200 + " é," * 40
    whole = [w for part in co.tokens(text) for w in part]
    monkeypatch.setattr(co, "SLICE", 17)
    assert [w for part in co.tokens(text) for w in part] == whole and whole[:5] == [b"ab", b"cd", b"\xff", b"ef", b"gh"]
    assert sum(w == b"x" * 200 for w in whole) == 1


def test_word_hash_is_spark_s(spark):
    words = [("en", "a"), ("de", "größer als 32 Bytes, und noch viel länger"), ("", "日本")]
    got = [r[0] for r in spark.createDataFrame(words, "lang string, word string").selectExpr("xxhash64(lang, word)").collect()]
    assert [g % 2**64 for g in got] == [co.word_hash(lang, w.encode()) for lang, w in words]


def test_scores_of_very_large_counts(spark):
    a, l, r = 3 * 10**15, 4 * 10**18, 5 * 10**18
    phrases = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r)], "lang string, phrase string, k int, f long")
    row = co.weakest_cuts(phrases).first()
    assert (row.score, row.l, row.r) == (2_000_000 * a // (l + r), l, r)
