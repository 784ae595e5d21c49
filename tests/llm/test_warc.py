import base64
import gzip
import hashlib
from pathlib import Path

from textpair.llm import warc
from textpair.session import shared_dir

ROWS = [
    (5, "http://a.example/x?q=1", "<p>one</p>"), (2, "http://b.example/é y", "<p>one</p>"), (9, None, None), (1, "http://c.example", ""),
    (7, "http://d.example\r\nX-Bad: 1", "two\r\n\r\nthree é 😀"), (None, "http://e.example", "<p>one</p>"), (None, "u", "alone"), (None, "u", "alone"),
    (3, "v", "same"), (3, "v", "same"), (11, "w", "x" * 3_000_000),
]
SCHEMA = "page_id long, url string, html string"


def want(rows, least=0):
    firsts = {}
    for page_id, _, html in rows:
        if page_id is not None and len((html or "").encode()) >= least:
            firsts[html or ""] = min(firsts.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data, first = (html or "").encode(), firsts.get(html or "")
        revisit = first is not None and first != page_id
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS refers_to", "2 AS _first").repartition(4)
    assert rows_of(warc.round_trip(pages)) == want(ROWS)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_selected_records_and_payloads(spark):
    folder = shared_dir(spark, "warc")
    index = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).coalesce(2), folder, least_bytes=5)
    assert index.count() == len(ROWS)
    chosen = warc.read_records(index.where("page_id IN (2, 7)"), folder).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in chosen} == {2: "<p>one</p>", 7: "two\r\n\r\nthree é 😀"}
    assert rows_of(warc.read_records(index, folder)) == want(ROWS, 5)
    # Archives are ordinary gzip members back to back; no header line is smuggled in.
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(folder).iterdir())
    assert text.count(b"WARC/1.1\r\n") == len(ROWS) and b"\r\nX-Bad" not in text


def test_ranges_are_coalesced():
    files, offsets, lengths = ["a", "a", "a", "b"], [0, 10, 10 + warc.GAP_BYTES + 100, 0], [10, 20, 5, 7]
    got = list(warc.coalesced(files, offsets, lengths))
    assert got == [("a", 0, [(0, 10), (10, 20)]), ("a", 10 + warc.GAP_BYTES + 100, [(10 + warc.GAP_BYTES + 100, 5)]), ("b", 0, [(0, 7)])]
