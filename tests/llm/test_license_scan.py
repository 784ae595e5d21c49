import random
import re

import pytest

from textpair.llm import license_scan as ls

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text):
    words = words_of(text)
    places = []
    for phrase, label in PHRASES.items():
        wanted = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def expanded(markup):
    """Regular expression over ' word word ' that a template stands for."""
    out, open_, parts = "", 0, ls.MARK.split(markup)
    for i, piece in enumerate(parts):
        if i % 2 == 0:
            out += "".join(re.escape(w.decode()) + " " for w in ls.words_of(piece))
        elif piece == "beginOptional":
            out += "(?:"
        elif piece == "endOptional":
            out += ")?"
        else:
            a, b = ls.VAR_WORDS.search(piece).groups()
            out += "(?:[^ ]+ ){%s,%s}" % (a, b)
    return out


TEXTS = [
    None, "", "Under the MIT License.", "x under_the-mit\nlicense UNDER THE MIT LICENSE", "Apache License, Version 2.0",
    "CC BY-NC 4.0 and cc/by/nc", "Éunder the mit license", "under the mit licenseé", "Kunder the mit license",
    "licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3",
    "under the GNU General Public License version 4", "Copyright (c) 2001 A. Nyone. All rights reserved.", "copyright all rights reserved",
    ls.LICENSE_TEMPLATES[0].markup.replace("<<beginOptional>>(including the next paragraph)<<endOptional>>", "").replace('<<var;name="holder";words="1..12">>', "THE AUTHORS OR COPYRIGHT HOLDERS"),
    ls.LICENSE_TEMPLATES[0].markup.replace("<<beginOptional>>(including the next paragraph)<<endOptional>>", "").replace('<<var;name="holder";words="1..12">>', "X").replace("free of charge", "for a charge"),
    "word " * 60_000 + "under the mit license",
]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    pool = "under the mit license apache version 2 cc by nc all rights reserved copyright gnu general public".split()
    texts = TEXTS + [" ".join(rng.choice(pool) for _ in range(rng.randrange(300))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS score")
    got = {r.doc_id: r for r in ls.digest(ls.scan(docs)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        joined = " " + "".join(w + " " for w in words_of(text))
        wanted = {t.label for t in ls.BASE_TEMPLATES + ls.LICENSE_TEMPLATES if re.search(" " + expanded(t.markup), joined)}
        assert r.labels == ",".join(sorted(wanted)), text[:80]
        assert (r.score == 1.0) == bool(wanted) and 0 <= r.score <= 1
    assert got[14].labels == "mit" and got[14].base_labels == "" and got[15].labels == "" and 0 < got[15].score < 1


def test_empty_table_and_repeated_rows(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "cc by nc"), (1, "cc by nc"), (None, None)]
    assert ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3


def test_templates_need_mandatory_words():
    for markup in ("<<beginOptional>>a<<endOptional>>", '<<var;name="x";words="1..2">> a', "<<beginOptional>> a"):
        with pytest.raises(ValueError):
            ls.compiled((ls.Template("t", "t", markup),))
