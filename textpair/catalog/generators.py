"""Three deterministic text generators, the Python twins of ``tables.generations``, and an embedder."""

from __future__ import annotations


def lead(texts: list[str]) -> list[str]:
    """The first few words."""
    pieces = [t.split() for t in texts]
    return [" ".join(w[: 2 + len(w) % 6]) for w in pieces]


def mid(texts: list[str]) -> list[str]:
    """A few words from the fourth on."""
    pieces = [t.split() for t in texts]
    return [" ".join(w[3 : 4 + len(w) % 5]) for w in pieces]


def tail(texts: list[str]) -> list[str]:
    """The last four words."""
    return [" ".join(t.split()[-4:]) for t in texts]


GENERATORS = {"org/lead": lead, "org/mid": mid, "org/tail": tail}


class VowelCounts:
    """A deterministic embedder: counts of vowels and spaces."""

    name = "vowel-counts"

    def load(self):
        return lambda texts: [[text.count(letter) for letter in "aeiou "] for text in texts]
