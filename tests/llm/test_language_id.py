import math
import random

import numpy as np
import public_tokenizers

from textpair.llm import language_id as li

PATH = public_tokenizers.path(li.VOCABULARY)


def brute(word, chances):
    """Sum over all segmentations, one by one."""
    pieces, _ = li.vocabulary(PATH)

    def ways(rest):
        if not rest:
            return 1.0
        total = 0.0
        for end in range(1, len(rest) + 1):
            number = pieces.get(rest[:end])
            p = chances[number] if number is not None else (li.UNKNOWN if end == 1 else 0.0)
            if p:
                total += p * ways(rest[end:])
        return total

    return ways("▁" + word)


def test_forward_sums_all_segmentations():
    size = len(li.vocabulary(PATH)[0])
    rng = np.random.default_rng(0)
    table = np.vstack([rng.random((size, 2)) / size, np.zeros(2), np.full(2, li.UNKNOWN)])
    for words in (["the", "and", "été"], ["a"], ["国際化"], ["questioning", "ßßßßßßßßßßß"]):
        got = li.log_probabilities(words, table, PATH)
        for word, row in zip(words, got, strict=True):
            for k in range(2):
                assert math.isclose(row[k], math.log(brute(word, table[:, k])), rel_tol=1e-9)


def test_expected_counts_cover_every_letter():
    pieces, _ = li.vocabulary(PATH)
    chances = np.concatenate([np.full(len(pieces), 1 / len(pieces)), [0, li.UNKNOWN]])
    counts = li.expected_counts(["things", "nation"], np.array([3.0, 2.0]), chances, PATH)
    lengths = np.array([*map(len, pieces), 0, 1])
    assert math.isclose((counts * lengths).sum(), 5 * 7, rel_tol=1e-9)


LANGUAGES = {
    "en": "the quick brown fox jumps over lazy dogs while nothing else happened in this town",
    "fr": "le renard brun saute par dessus les chiens paresseux pendant que rien ne bouge ici",
    "de": "der schnelle braune fuchs springt über faule hunde während nichts anderes geschah",
}


def rows(n=300):
    rng = random.Random(2)
    out = []
    for i in range(n):
        lang = rng.choice(list(LANGUAGES))
        out.append((i, " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(rng.randrange(3, 40))), lang))
    return out


SCHEMA = "doc_id long, text string, lang string"


def test_held_out_accuracy_and_edge_cases(spark):
    long = "Der schnelle Fuchs! " * 30_000 + "x" * 20_000
    edge = [(1000, None, "en"), (1001, "", "fr"), (1002, "12 34 !!", "de"), (1003, long, None), (None, "the dogs", None), (4, "repeat the dogs", "en"), (4, "repeat the dogs", "en")]
    docs = spark.createDataFrame(rows() + edge, SCHEMA).selectExpr("*", "1 AS score", "2 AS c0").repartition(4)
    got = li.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = {r.doc_id: r for r in got.collect()}
    truth = {r[0]: r[2] for r in rows()}
    held = [d for d in truth if found[d].held_out]
    assert len(held) > 50 and sum(found[d].lang_pred == truth[d] for d in held) >= 0.97 * len(held)
    assert [found[d].lang_pred for d in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "de", "en"]
    assert found[1000].score == 0 and 0.9 < found[1003].score <= 1 and found[None].held_out is False
    assert got.count() == 307


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "the dogs", None)], SCHEMA)
    assert [r.lang_pred for r in li.identify(docs).collect()] == ["und"]
    assert li.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_letters_are_those_of_isalpha(spark):
    """Numerals of other kinds are no letters; every letter of every script is one."""
    assert not any(li.words_of(c) for c in "²½①Ⅷ٣_7")
    letters = [c for c in map(chr, range(0x30000)) if c.isalpha() and c.lower() == c]
    assert all(li.words_of(c) == [c] for c in letters)
    docs = spark.createDataFrame([(i, "ab cd ef", "en") for i in range(50)] + [(100, "² ½", "en"), (101, "Ⅷ", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(docs).collect()}
    assert got[100] == got[101] == ("und", 0.0)


def test_long_runs_without_spaces_are_learned(spark):
    """A language whose documents are single long runs is learned from all their letters."""
    rng = random.Random(7)
    runs = [("".join(rng.choices("アイウエオカキ", k=500)), "ja") for _ in range(60)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(runs + [("the cat and the dog", "en")] * 60)], "doc_id long, text string, lang string")
    got = li.identify(docs).collect()
    assert {r.lang_pred for r in got if r.doc_id < 60} == {"ja"} and {r.lang_pred for r in got if r.doc_id >= 60} == {"en"}
    assert "".join(li.learned_parts(runs[0][0])) == runs[0][0]


def test_every_labelled_document_counts(spark):
    """Models and thresholds come from all labelled rows, however many a language has."""
    docs = spark.range(9_000).selectExpr("id AS doc_id", "concat('common w', translate(id, '0123456789', 'abcdefghij')) AS text", "'en' AS lang")
    fitted = li.with_fits(docs, li.learn(docs))
    assert fitted.columns == ["doc_id", "text", "lang", "_found", "_score", "_fit"] and fitted.count() == 9_000
    counted = docs.select("lang", "text").mapInArrow(li.count_batches, "lang string, word string, n long")
    assert counted.where("word = 'common'").agg({"n": "sum"}).first()[0] == 9_000
    # 200 of 8,000 rows fit badly: the lowest fit follows their whole lower end.
    ends = spark.range(8_000).selectExpr("'en' AS lang", "'en' AS _found", "IF(id = 0, -90.0D, IF(id < 200, -9.0D, -2.0D)) AS _fit")
    assert li.lowest_fits(ends) == {"en": -2.0 - li.MARGIN * 7.0}
    assert li.accepted(docs, li.learn(docs), 0.5).columns == docs.columns


def test_accepted_stores_no_texts(spark, monkeypatch):
    """The same rows as a filter on scored documents, copies and nulls included, and no document is written on the way."""
    bad = [(2000, None, "en"), (2001, "12 34", None), (2002, "zzq xqv wwk jjq", None), (None, "zzq xqv wwk jjq", None), (None, "the dogs jumps over", None)]
    docs = spark.createDataFrame(rows(3_000) + rows(50) + bad, SCHEMA).selectExpr("*", "doc_id AS _digest", "'x' AS _fit").repartition(4)
    model = li.learn(docs)
    fitted = li.with_fits(docs.drop("_fit"), model)
    ends = li.lowest_fits(fitted)
    want = sorted(
        (str(r.doc_id), r.text, str(r.lang)) for r in fitted.collect()
        if r._found != "und" and r._score >= 0.5 and r._fit >= ends.get(r._found, -math.inf)
    )
    written = {}

    def watched(df, name, own=li.stored):
        written[name] = df.columns
        return own(df, name)

    monkeypatch.setattr(li, "stored", watched)
    got = li.accepted(docs, model, 0.5)
    assert got.columns == docs.columns and len(want) >= 3_040
    assert sorted((str(r.doc_id), r.text, str(r.lang)) for r in got.collect()) == want
    assert not any("zzq" in text for _, text, _ in want)
    assert written and not any({"text", "doc_id"} & set(columns) for columns in written.values())


def test_lattice_follows_all_substrings_at_once():
    """Piece numbers as looked up one by one; shared beginnings are followed once, without a lookup per substring."""
    pieces, longest = li.vocabulary(PATH)
    rng = random.Random(3)
    words = {"".join(rng.choices(sorted(pieces), k=rng.randrange(1, 4))).replace(li.START, "") for _ in range(2_000)}
    words |= {"国際化", "ßß", "x", "𐐨𐐩", "q" * 60, "questioning"}
    for group in li.by_length(words - {""}):
        ids, ends = li.lattice(group, PATH)
        size = len(group[0]) + 1
        assert ends == [min(j, longest) for j in range(1, size + 1)]
        for word, row in zip(group, ids.tolist(), strict=True):
            marked = li.START + word
            spans = [marked[i:j] for j in range(1, size + 1) for i in range(j - 1, max(j - longest, 0) - 1, -1)]
            assert row == [pieces.get(s, len(pieces) + (len(s) == 1)) for s in spans]


def test_lattice_asks_no_dictionary(monkeypatch):
    """The number of Python steps does not follow the number of substrings."""
    numbers, longest, walk = li.read(PATH)

    class Silent(dict):
        def get(self, *args):
            raise AssertionError("a substring was looked up alone")

    monkeypatch.setattr(li, "read", lambda path: (Silent(numbers), longest, walk))
    ids, _ = li.lattice(["things", "nation"], PATH)
    assert ids.shape == (2, 28)
