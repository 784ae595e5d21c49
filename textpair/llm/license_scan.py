"""License scans by template-markup matching.

A template is wording with regions in markup: what stands between
``<<beginOptional>>`` and ``<<endOptional>>`` may be missing, and
``<<var;name="owner";words="0..8">>`` stands for any words, so many.  All other
words are mandatory and must match exactly.  Each template is compiled into an
automaton over words; a text is accepted wherever an automaton that was started
at a word reaches its end.

Texts lower-case A-Z; words are runs of ASCII letters, digits and any other
characters beyond ASCII, so punctuation and line breaks do not matter.

One pass over the whole text per document, no shuffle.  Automata are started
only at words a template can begin with and are small, so the work per start is
bounded by the longest template.

Edge cases: null and empty texts have no words; places may overlap and all
count; repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpair.session import ship_package


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    markup: str
    base: bool = False


# Fixed by contract: phrases and their labels.
BASE_TEMPLATES = (
    Template("mit-phrase", "mit", "under the mit license", True),
    Template("apache-2-phrase", "apache-2", "apache license version 2", True),
    Template("cc-by-nc-phrase", "cc-by-nc", "cc by nc", True),
)
# Wording of public license texts and notices, regions marked.
LICENSE_TEMPLATES = (
    Template("mit-text", "mit", (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        'the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and '
        'to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above '
        'copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall '
        'be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT '
        'WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
        'FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";words="1..12">> BE LIABLE FOR '
        'ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF '
        'OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    )),
    Template("isc-text", "isc", (
        'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose '
        'with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear '
        'in all copies.'
    )),
    Template("apache-2-notice", "apache-2", (
        'Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License")<<endOptional>>; you may not use '
        '<<var;name="work";words="1..4">> except in compliance with the License.'
    )),
    Template("gpl-3-notice", "gpl-3", (
        'under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License '
        '<<beginOptional>>as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either'
        '<<endOptional>> version 3'
    )),
    Template("gpl-2-notice", "gpl-2", (
        'under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License '
        '<<beginOptional>>as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either'
        '<<endOptional>> version 2'
    )),
    Template("all-rights-reserved", "all-rights-reserved", (
        '<<beginOptional>>copyright <<var;name="owner";words="0..8">><<endOptional>> all rights reserved'
    )),
)

WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
VAR_WORDS = re.compile(r'words="(\d+)\.\.(\d+)"')

SPAN = "struct<label:string,template:string,start:long,end:long,base:boolean>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


@dataclass
class Automaton:
    """States of all templates; ``skips`` are moves without a word."""

    words: list[dict[bytes, int]] = field(default_factory=list)
    anything: list[int | None] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    share: list[float] = field(default_factory=list)
    accepts: dict[int, Template] = field(default_factory=dict)
    first: dict[bytes, list[int]] = field(default_factory=dict)

    def state(self) -> int:
        self.words.append({})
        self.anything.append(None)
        self.skips.append([])
        self.share.append(0.0)
        return len(self.words) - 1

    def closure(self, states) -> set[int]:
        seen, todo = set(states), list(states)
        while todo:
            for target in self.skips[todo.pop()]:
                if target not in seen:
                    seen.add(target)
                    todo.append(target)
        return seen

    def add(self, template: Template) -> None:
        begin = at = self.state()
        opened: list[int] = []
        mandatory: list[int] = []

        def step(word: bytes | None) -> int:
            """One more state after ``at``: by a given word, or by any word."""
            target = self.state()
            if word is None:
                self.anything[at] = target
            else:
                self.words[at][word] = target
                if not opened:
                    mandatory.append(target)
            self.share[target] = len(mandatory)
            return target

        for i, piece in enumerate(MARK.split(template.markup)):
            if i % 2 == 0:
                for word in words_of(piece):
                    at = step(word)
            elif piece == "beginOptional":
                # A state of its own keeps the way around the region apart.
                entry = self.state()
                self.share[entry] = len(mandatory)
                self.skips[at].append(entry)
                opened.append(entry)
                at = entry
            elif piece == "endOptional":
                leave = self.state()
                self.share[leave] = len(mandatory)
                self.skips[at].append(leave)
                self.skips[opened.pop()].append(leave)
                at = leave
            else:
                least, most = map(int, VAR_WORDS.search(piece).groups())
                ways = []
                for n in range(most + 1):
                    if n >= least:
                        ways.append(at)
                    if n < most:
                        at = step(None)
                leave = self.state()
                self.share[leave] = len(mandatory)
                for way in ways:
                    self.skips[way].append(leave)
                at = leave
        if not mandatory or opened:
            raise ValueError(f"template {template.name} has no mandatory word or an open region")
        for target in range(begin, len(self.share)):
            self.share[target] /= len(mandatory)
        self.accepts[at] = template
        for source in self.closure([begin]):
            if self.anything[source] is not None:
                raise ValueError(f"template {template.name} begins with any word")
            for word, target in self.words[source].items():
                self.first.setdefault(word, []).append(target)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[Template, int, int]], float]:
        """All places ``(template, start, end)`` and the largest share of mandatory words reached."""
        spans: list[tuple[Template, int, int]] = []
        best = 0.0
        first = self.first
        for start in [i for i, word in enumerate(words) if word in first]:
            active = self.closure(first[words[start]])
            end = start + 1
            longest: dict[Template, int] = {}
            while active:
                for state in active:
                    best = max(best, self.share[state])
                    if state in self.accepts:
                        longest[self.accepts[state]] = end
                if end >= len(words):
                    break
                word = words[end]
                reached = {self.words[s][word] for s in active if word in self.words[s]}
                reached |= {self.anything[s] for s in active if self.anything[s] is not None}
                active = self.closure(reached)
                end += 1
            spans += [(template, start, stop) for template, stop in longest.items()]
        return spans, best


@cache
def compiled(templates: tuple[Template, ...]) -> Automaton:
    automaton = Automaton()
    for template in templates:
        automaton.add(template)
    return automaton


def scan_batches(templates: tuple[Template, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(templates)
        for batch in batches:
            counts, found, scores = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                spans, score = automaton.scan(words)
                counts.append(len(words))
                scores.append(score)
                found.append([
                    {"label": t.label, "template": t.name, "start": a, "end": b, "base": t.base} for t, a, b in spans
                ])
            kind = pa.list_(pa.struct([
                ("label", pa.string()), ("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                ("base", pa.bool_()),
            ]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(scores, pa.float64())],
                names=["doc_id", "n_words", "spans", "score"],
            )

    return run


def scan(docs: DataFrame, templates=BASE_TEMPLATES + LICENSE_TEMPLATES) -> DataFrame:
    """``doc_id, n_words, spans, score`` per document.

    ``spans`` are all accepted places (words from 0, end excluded; the longest
    per start and template).  ``score`` is the largest share of a template's
    mandatory words that was reached, 1 where a template is accepted.
    """
    ship_package(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(
        scan_batches(tuple(templates)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, spans array<{SPAN}>, score double"
    )


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and labels of the base phrases and of all templates."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), "score",
    )
