"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces of
the product of their probabilities, computed by the forward algorithm; pieces
do not cross words, so a text's log-probability is the sum over its words.
Texts are lower-cased, words are runs of letters with a word-start mark.

Learning is expectation-maximisation on the counted words of all documents
with a language.  Words are counted in Spark; expected piece counts are summed
in Spark; the driver sees one row per piece and language.

Prediction reads whole texts.  The result of a word is remembered, up to a
bound, by the Python worker that has computed it.

The score is the share of the best language among the learned ones, so it is
near 1 for any text of some words, in whatever language.  Whether a text is in
its best language at all is told by its fit: the log-probability per letter
(word starts count as letters).  ``accepted`` scores every document once and
drops what lies far below the fits of the labelled ones, all of which
``lowest_fits`` reads; what it stores holds no texts.  A text that is labelled with a wrong language and
learned from counts as text of it.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as
are all texts where nothing could be learned; a letter outside the vocabulary
has the same small probability in every language; equal log-probabilities take
the first language in order; rows without an id are never learned from and not
held out; repeated rows are predicted each.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpair.llm.common import frugal, resident, stored
from textpair.session import ship_package

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 2
SMOOTHING = 0.1
UNKNOWN = 1e-7
# Longer runs of letters are learned from in parts, whose chances stay within a double.
LONGEST_LEARNED = 60
REMEMBERED_WORDS = 250_000
CHARS_AT_ONCE = 1_000_000
WORDS_AT_ONCE = 2_048
RESCALE = 8
# A text is not in a language if its fit is below the median of the learned documents by more than so many times the
# distance from there to their lowest hundredth, and by more than LEAST_MARGIN.
LOW_END = 0.01
MARGIN = 4
LEAST_MARGIN = 1.0

# Runs of letters and of numerals that are no decimal digits; ``words_of`` takes the latter out.
WORD = re.compile(r"[^\W\d_]+")
START = "▁"
UNDETERMINED = "und"


def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """Pieces and their numbers, and the length of the longest."""
    return read(path)[:2]


def read(path: str) -> tuple[dict[str, int], int, Trie]:
    """The vocabulary and its trie, kept by the worker."""
    return resident(f"pieces:{path}", lambda: read_vocabulary(path))


def read_vocabulary(path: str) -> tuple[dict[str, int], int, Trie]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    numbers = {piece: i for i, piece in enumerate(pieces)}
    return numbers, max(map(len, pieces)), read_trie(numbers)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, which are what ``str.isalpha`` takes."""
    words = WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [part for word in words for part in "".join(c if c.isalpha() else " " for c in word).split()]


@dataclass
class Trie:
    """The pieces by letters: ``steps`` are sorted keys of (node, letter), which lead to the nodes 1, 2, ... in ``nodes``."""

    letters: np.ndarray  # number of each code point, 0 if no piece has it
    steps: np.ndarray
    nodes: np.ndarray
    pieces: np.ndarray  # number of the piece that ends at a node, else -1

    def follow(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which places have a next node, and these nodes."""
        key = (node << 21) + letter
        at = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
        found = np.flatnonzero(self.steps[at] == key)
        return found, self.nodes[at[found]]


def read_trie(pieces: dict[str, int]) -> Trie:
    letters = np.zeros(0x110000, np.int32)
    steps: dict[int, int] = {}
    ends: dict[int, int] = {}
    for number, letter in enumerate(sorted(set().union(*pieces)), 1):
        letters[ord(letter)] = number
    for piece, number in pieces.items():
        node = 0
        for letter in piece:
            node = steps.setdefault((node << 21) + int(letters[ord(letter)]), len(steps) + 1)
        ends[node] = number
    keys, nodes = np.array(list(steps), np.int64), np.array(list(steps.values()), np.int64)
    order = np.argsort(keys)
    numbers = np.full(len(steps) + 1, -1, np.int32)
    numbers[list(ends)] = list(ends.values())
    return Trie(letters, keys[order], nodes[order], numbers)


def lattice(words: list[str], path: str) -> tuple[np.ndarray, list[int]]:
    """Piece numbers of all substrings of words of one length, and how many end at each place.

    Columns are ordered by end, then from the shortest piece.  A substring that is
    no piece has number V (probability 0), a lone letter that is none V + 1.  All
    words are followed through the trie at once, from all places.
    """
    pieces, longest, walk = read(path)
    size = len(words[0]) + 1
    ends = [min(j, longest) for j in range(1, size + 1)]
    first = np.concatenate([[0], np.cumsum(ends)])
    ids = np.full((len(words), first[-1]), len(pieces), np.int32)
    ids[:, first[:-1]] = len(pieces) + 1
    points = np.array([START + word for word in words]).view(np.uint32).reshape(len(words), size)
    letters = walk.letters[points].astype(np.int64)
    word, place = (x.ravel() for x in np.indices((len(words), size)))
    node = np.zeros(len(word), np.int64)
    for length in range(longest):
        inside = place + length < size
        word, place, node = word[inside], place[inside], node[inside]
        found, node = walk.follow(node, letters[word, place + length])
        word, place = word[found], place[found]
        if not len(word):
            break
        number = walk.pieces[node]
        ending = np.flatnonzero(number >= 0)
        ids[word[ending], first[place[ending] + length] + length] = number[ending]
    return ids, ends


def forward(ids: np.ndarray, ends: list[int], table: np.ndarray, rescale: bool = True):
    """Forward sums per prefix, ``(words, prefixes, languages)``, and the log of the scale taken out."""
    n, languages = len(ids), table.shape[1]
    sums = np.zeros((n, len(ends) + 1, languages))
    sums[:, 0] = 1.0
    scale = np.zeros(n)
    column = 0
    for j, width in enumerate(ends, 1):
        chances = table[ids[:, column : column + width]]
        column += width
        sums[:, j] = np.einsum("nkl,nkl->nl", chances, sums[:, j - width : j][:, ::-1])
        if rescale and j % RESCALE == 0:
            top = sums[:, j].max(axis=1)
            sums[:, max(j + 1 - max(ends), 0) : j + 1] /= top[:, None, None]
            scale += np.log(top)
    return sums, scale


def by_length(words) -> Iterator[list[str]]:
    """Words of one length each, in batches of bounded size."""
    groups = defaultdict(list)
    for word in words:
        groups[len(word)].append(word)
    for length, group in groups.items():
        step = max(1, min(WORDS_AT_ONCE, 40_000 // length))
        for start in range(0, len(group), step):
            yield group[start : start + step]


def log_probabilities(words: list[str], table: np.ndarray, path: str) -> np.ndarray:
    """Of words of one length, summed over all segmentations."""
    sums, scale = forward(*lattice(words, path), table)
    return np.log(np.maximum(sums[:, -1], 1e-300)) + scale[:, None]


def expected_counts(words: list[str], counts: np.ndarray, chances: np.ndarray, path: str) -> np.ndarray:
    """Expected uses of each piece in counted words of one length, for one language."""
    ids, ends = lattice(words, path)
    forwards = forward(ids, ends, chances[:, None], rescale=False)[0][:, :, 0]
    size = len(ends)
    backwards = np.zeros((len(ids), size + 1))
    backwards[:, size] = 1.0
    total = np.zeros(len(chances))
    column = ids.shape[1]
    weight = counts / forwards[:, size]
    for j in range(size, 0, -1):
        width = ends[j - 1]
        column -= width
        own = ids[:, column : column + width]
        use = chances[own] * backwards[:, j : j + 1]
        backwards[:, j - width : j] += use[:, ::-1]
        use = use * forwards[:, j - width : j][:, ::-1] * weight[:, None]
        total += np.bincount(own.ravel(), use.ravel(), len(chances))
    return total


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # piece x language, then a row of 0 and a row for unknown letters
    path: str


class Scorer:
    """Scores texts; keeps the results of words up to a bound."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.places: dict[str, int] = {}
        self.known = np.empty((REMEMBERED_WORDS, len(model.languages)), np.float64)

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.places)
        if len(self.places) + len(new) > len(self.known):
            self.places.clear()
            new = words
            if len(new) > len(self.known):
                self.known = np.empty((len(new), len(self.model.languages)))
        for group in by_length(new):
            at = len(self.places)
            self.known[at : at + len(group)] = log_probabilities(group, self.model.table, self.model.path)
            self.places.update(zip(group, range(at, at + len(group)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        named, scores, fits = [], [], []
        group: list[list[str]] = []
        chars = 0
        for text in [*texts, None]:
            group.append(words_of(text))
            chars += len(text or "")
            if chars >= CHARS_AT_ONCE or len(named) + len(group) > len(texts):
                self.learn({w for words in group for w in words})
                for words in group:
                    name, score, fit = self.of_words(words)
                    named.append(name)
                    scores.append(score)
                    fits.append(fit)
                group, chars = [], 0
        return named[: len(texts)], scores[: len(texts)], fits[: len(texts)]

    def of_words(self, words: list[str]) -> tuple[str, float, float | None]:
        """The best language, its share among the learned ones and the text's fit to it."""
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0, None
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        total = self.known[at].sum(axis=0)
        best = int(total.argmax())
        letters = sum(map(len, words)) + len(words)
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum()), float(total[best]) / letters


def learned_parts(word: str) -> list[str]:
    """A run of letters to learn from; a long one in parts, all of which count."""
    if len(word) <= LONGEST_LEARNED:
        return [word]
    return [word[i : i + LONGEST_LEARNED] for i in range(0, len(word), LONGEST_LEARNED)]


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words counted per language; a task hands them on when it holds more than ``REMEMBERED_WORDS``."""
    held: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            parts: Counter = Counter()
            for word, n in counts.items():
                for part in learned_parts(word):
                    parts[part] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(parts), pa.string()), pa.array(list(parts), pa.string()), pa.array(list(parts.values()), pa.int64())],
                names=["lang", "word", "n"],
            )
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held[lang].update(words_of(text))
        if sum(map(len, held.values())) > REMEMBERED_WORDS:
            yield from out()
    yield from out()


def expectation_batches(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(model.table.shape)
        for batch in batches:
            counted: dict[str, dict[str, int]] = defaultdict(dict)
            rows = zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True)
            for lang, word, n in rows:
                counted[lang][word] = n
            for lang, words in counted.items():
                column = model.languages.index(lang)
                for group in by_length(words):
                    n = np.array([words[w] for w in group], float)
                    totals[:, column] += expected_counts(group, n, model.table[:, column], model.path)
        piece, column = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int32()), pa.array(column, pa.int32()), pa.array(totals[piece, column], pa.float64())],
            names=["piece", "language", "expected"],
        )

    return run


def learn(docs: DataFrame, path: str | None = None) -> LanguageModel:
    """Piece probabilities from the documents' ``text`` and non-null ``lang``."""
    ship_package(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    # Few bytes but much work: a fixed number of files, which adaptive plans would make one.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = stored(
        docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(frugal(count_batches), "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(tasks, "word"),
        "language-words",
    )
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    size = len(vocabulary(path)[0])
    table = np.full((size + 2, len(languages)), 1.0 / size)
    table[size], table[size + 1] = 0.0, UNKNOWN
    model = LanguageModel(languages, table, path)
    for _ in range(ROUNDS if languages else 0):
        sums = words.mapInArrow(expectation_batches(model), "piece int, language int, expected double")
        expected = np.zeros_like(table)
        for r in sums.groupBy("piece", "language").agg(F.sum("expected").alias("n")).toLocalIterator():
            expected[r["piece"], r["language"]] = r["n"]
        counts = expected[:size] + SMOOTHING
        table = np.vstack([counts / counts.sum(axis=0), np.zeros(len(languages)), np.full(len(languages), UNKNOWN)])
        model = LanguageModel(languages, table, path)
    return model


def predict_batches(model: LanguageModel, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            named, scores, _ = scorer.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(named, pa.string()), pa.array(scores, pa.float64())],
                names=[*columns, "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``; only they and the text reach Python."""
    columns = [f"c{i}" for i in range(len(keep))]
    rows = docs.select("text", *[F.col(c).alias(a) for c, a in zip(keep, columns, strict=True)])
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double")
    done = rows.mapInArrow(frugal(predict_batches(model, columns)), schema)
    return done.select(*[F.col(a).alias(c) for c, a in zip(keep, columns, strict=True)], "lang_pred", "score")


def fit_batches(model: LanguageModel, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            named, scores, fits = scorer.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, columns), pa.array(named, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())],
                names=[*columns, "_found", "_score", "_fit"],
            )

    return run


def with_fits(docs: DataFrame, model: LanguageModel, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (by default all) with the language found (``_found``), its ``_score`` and the text's ``_fit`` to it."""
    columns = docs.columns if columns is None else columns
    schema = T.StructType([docs.schema[c] for c in columns]).add("_found", "string").add("_score", "double").add("_fit", "double")
    return docs.mapInArrow(frugal(fit_batches(model, columns)), schema)


def lowest_fits(fitted: DataFrame) -> dict[str, float]:
    """The fit a text needs to be in a language, from all labelled rows of ``with_fits`` that are found to be in theirs."""
    ends = (
        fitted.where("lang = _found").groupBy("lang").agg(F.percentile_approx("_fit", [LOW_END, 0.5]).alias("ends")).collect()
    )
    return {r["lang"]: r["ends"][1] - max(MARGIN * (r["ends"][1] - r["ends"][0]), LEAST_MARGIN) for r in ends}


def accepted(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The documents in a language with at least the score ``least`` and the language's lowest fit, all columns unchanged.

    Texts are scored once and only hashes of them are stored with the fits.  A verdict depends on the text alone, so
    the documents are those whose text is not among the rejected ones: few, which Spark sends to the tasks, or joined.
    """
    digest = F.unhex(F.sha2(docs["text"].cast("binary"), 256))
    fitted = stored(with_fits(docs.select(digest.alias("_digest"), "lang", "text"), model, ["_digest", "lang"]), "language-fits")
    need = F.lit(float("-inf"))
    for lang, lowest in lowest_fits(fitted).items():
        need = F.when(F.col("_found") == lang, F.lit(lowest)).otherwise(need)
    sure = (F.col("_found") != UNDETERMINED) & (F.col("_score") >= least) & (F.col("_fit") >= need)
    rejected = stored(fitted.where(~F.coalesce(sure, F.lit(False))).select("_digest").distinct(), "language-rejected")
    return docs.where(docs["text"].isNotNull()).join(rejected, digest == rejected["_digest"], "left_anti")


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of the id as text leaves the remainder ``part``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learns from rows that are not held out."""
    out = held_out(F.col("doc_id"), 3, 1)
    model = learn(docs.where("doc_id IS NOT NULL").where(~out))
    return predict(docs, model, ["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score")
