"""Secrets in texts: fixed patterns, and strings that dictionary-primed compression finds new.

Three patterns give the base spans.  The method adds others: a candidate is a
long run of key characters with a sensitive word shortly before it.  Its
novelty is the number of bytes by which a zstandard frame grows when the
candidate is put back into its surroundings, the compressor being primed with
a dictionary of identifiers.  Words, paths and names built from identifiers, and
strings that the surrounding text repeats, cost little; random keys cost close
to their entropy and are reported.

A text is scanned on its own, in one pass over the table without a shuffle.
Patterns look at whole texts; the surroundings of a candidate are a bounded
number of characters on both sides, which is what novelty means here, not a
bound on what is scanned.

Edge cases: a null or empty text has no spans; repeated rows are scanned row by
row; an empty table gives an empty result.  Offsets count code points, ends are
exclusive.  Columns of the input beside ``doc_id`` and ``text`` are not read, so
their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpair.session import ship_package

# Fixed by contract: patterns, the least length of what counts, and their order at one place.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16
# Runs of 32 or more: each is a whole run, as no run can be matched twice.
HEX = re.compile("[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

# A candidate of the method, and how far before it a sensitive word may stand.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~$-]{16,}")
SENSITIVE = re.compile(
    r"auth|bearer|cert|cookie|credential|cred_|key|passphrase|passw|private|pwd|secret|session|signature|token",
    re.IGNORECASE | re.ASCII,
)
# One of these is in the lower-cased text wherever SENSITIVE or ASSIGN match.
HINTS = ("auth", "bearer", "cert", "cookie", "cred", "key", "pass", "private", "pwd", "secret", "session", "signature", "token")
REACH = 48
AROUND = 1024
# Marginal bytes per character from which a candidate is incompressible.  Measured among prose: random strings of 20 to 40
# letters and digits cost 0.9 to 1.5 (they also spoil the literals' code), names and paths 0.2 to 0.8.
LEAST_NOVELTY = 0.85
LEVEL = 3

# Identifiers that code and configuration use often, the dictionary that primes the compressor (fixed values).
IDENTIFIERS = """
access_key access_token account address admin api_key apikey application args array async attribute auth authorization
await backup base64 bearer begin boolean bucket buffer build cache callback certificate char class client client_id
client_secret cluster code collection column command comment commit common component config configuration connect
connection console const constructor container content context continue controller cookie count create created_at
credentials current data database dataset date datetime debug default define delete description destination detail
device directory document domain double element email enabled encoding endpoint engine entry enum environment error
event example exception execute exists export extends factory false field file filename filter final float folder
format function generate getElementById group handler hash header height hidden host hostname http https identifier
implements import include index info input instance integer interface internal iterator json keyword label lambda
language latest length level library license limit list listener local localhost location logger login long manager
map master message metadata method middleware model module name namespace node null number object offset operation
option optional order output override package page parameter params parent parse passphrase password path pattern
payload permission pipeline platform plugin policy port prefix primary private private_key process production profile
project property protected protocol provider public public_key query queue random range read record redirect reference
region register registry release remote render replace repository request required reset resource response result
return role root route row runtime schema schedule scope script search secret secret_key section security select self
sequence server service session session_id settings signature size socket source staging start state static status
storage stream string struct style subject submit success suffix switch system table target task template test text
thread throw timeout timestamp title token total transaction true type undefined union unique update updated_at upload
uri url user user_id username util uuid valid value variable vector verbose version view virtual void volume warning
web webhook while width window worker workspace wrapper write xml yaml zone
/etc/ssl/certs /home/user /opt /tmp /usr/bin /usr/local/lib/python3/site-packages /usr/local/bin /usr/share /var/lib /var/log
bin lib node_modules resources src/main/java src/test/resources target/classes
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789
"""

SPAN = "struct<kind:string,start:int,end:int,novelty:double>"
FOUND = f"doc_id long, spans array<{SPAN}>"


class Novelty:
    """Marginal compressed bytes per character; one per task."""

    def __init__(self) -> None:
        words = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False
        )

    def __call__(self, text: str, start: int, end: int) -> float:
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        without = len(self.compressor.compress((before + after).encode()))
        whole = len(self.compressor.compress((before + after + text[start:end]).encode()))
        return (whole - without) / (end - start)


def base_spans(text: str, hinted: bool) -> list[tuple[str, int, int]]:
    """What the patterns find, by start, then in the order of the kinds."""
    spans = []
    if hinted:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of key characters with a letter and a digit, after a sensitive word, that no base span touches."""
    spans, at = sorted((start, end) for _, start, end in taken), 0
    reach = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(spans) and spans[at][0] < end:
            reach = max(reach, spans[at][1])
            at += 1
        if reach > start:
            continue
        mixed = any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])
        if mixed and SENSITIVE.search(text, max(0, start - REACH), start):
            yield start, end


def scan_text(text: str | None, novelty: Novelty) -> list[tuple[str, int, int, float | None]]:
    """All spans ``(kind, start, end, novelty)`` of one text, by start, then kind."""
    if not text:
        return []
    lowered = text.lower()
    hinted = any(h in lowered for h in HINTS)
    base = base_spans(text, hinted)
    spans = [(*s, None) for s in base]
    if hinted:
        for start, end in candidates(text, base):
            measured = novelty(text, start, end)
            if measured >= LEAST_NOVELTY:
                spans.append(("novel", start, end, measured))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    novelty = Novelty()
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())])
    for batch in batches:
        found = []
        for text in batch.column("text"):
            spans = scan_text(text.as_py(), novelty)
            found.append([dict(zip(("kind", "start", "end", "novelty"), s, strict=True)) for s in spans])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, novelty of the method's) of every text."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan_batches, FOUND)


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of each pattern, the base spans' hash and all spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = written(F.filter("spans", lambda s: s["kind"] != "novel"))
    return found.select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(F.encode(base, "utf-8"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"), count("novel"),
    )
