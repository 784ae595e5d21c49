"""One large CSV file read by many tasks, also where cells hold line breaks.

Spark's text source deals out byte ranges of a file and gives every line to one
range.  A line begins a record if an even number of quotes stands before it in
the file.  So the quotes of each range are counted first, the parities before
the ranges follow from a running sum over one row per range, and each task then
knows which of its lines begin records.  Records that lie across the edge of a
range are put together from their pieces, at most two a range; all others never
leave their task.  Spark's ``from_csv`` takes the records apart.

The files are scanned three times (quotes, whole records, pieces; the last only
where a range begins or ends inside a record) and not written anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEAD, TAIL = 0, 1
_RECORDS = "file string, start long, part int, first boolean, record string"
# A record whose quotes enclose whole cells, as CSV writers set them.
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",\n]*+)'
_WELL_QUOTED = re.compile(rf"{_CELL}(?:,{_CELL})*+\r?")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files as texts; ``first`` marks the header of each file.

    Records may span lines and ranges.  Blank lines between records are left
    out.  A quote that does not enclose a cell and so would hide a record's end
    is an error, and so is a file that ends inside a cell.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    in_file = Window.partitionBy("file").orderBy("start")
    # One row per range, under a million at 100 TB.  Only ranges with an edge
    # inside a cell are sent to the tasks.
    odd = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    edges = odd.select("file", "start", (F.sum("odd").over(in_file) % 2 != 0).alias("open"), "odd").select(
        "file", "start", (F.col("open") != (F.col("odd") != 0)).alias("inside"), "open"
    ).where("inside OR open")
    edges = F.broadcast(edges.drop("open"))
    # Broadcast joins leave the lines of a range together and in order.
    whole = _cut(lines.join(edges, ["file", "start"], "left"), pieces=False).select("first", "record")
    return whole.unionByName(_joined(_cut(lines.join(edges, ["file", "start"]), pieces=True)))


def _cut(lines: DataFrame, pieces: bool) -> DataFrame:
    # A line need not carry its file's path where only the turn to another file matters.
    file = F.col("file") if pieces else F.xxhash64("file").alias("file")
    inside = F.coalesce("inside", F.lit(False)).alias("inside")
    return lines.select(file, "start", inside, "value").mapInArrow(_cutter(pieces), _RECORDS)


def _joined(pieces: DataFrame) -> DataFrame:
    """Records from their pieces: every tail begins one, the heads behind it continue it."""
    order = Window.partitionBy("file").orderBy("start", "part")
    together = (
        pieces.withColumn("number", F.sum("part").over(order))
        .groupBy("file", "number")
        .agg(F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("start", "part", "record"))).alias("parts"))
        .select("first", F.concat_ws("\n", F.col("parts")["record"]).alias("record"))
    )
    return together.mapInArrow(_check_batches, "first boolean, record string")


def _check(record: str) -> str:
    if not _WELL_QUOTED.fullmatch(record):
        raise ValueError(
            f"a quote inside an unquoted cell, or a cell without an end: {record[:80]!r}; "
            "such files can only be read with by_range=False"
        )
    return record[:-1] if record.endswith("\r") else record


def _check_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        records = pa.array([_check(r) for r in batch.column("record").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("first"), records], names=["first", "record"])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str | int, int, bool, pa.Array]]:
    """The lines of each range in a batch."""
    starts = batch.column("start").to_numpy(zero_copy_only=False)
    files = batch.column("file")
    numbers = (files.dictionary_encode().indices if pa.types.is_string(files.type) else files).to_numpy(zero_copy_only=False)
    turns = np.flatnonzero((starts[1:] != starts[:-1]) | (numbers[1:] != numbers[:-1])) + 1
    bounds = [0, *turns.tolist(), len(starts)]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        if high > low:
            yield files[low].as_py(), int(starts[low]), batch.column("inside")[low].as_py(), batch.column("value")[low:high]


class _Range:
    """The records of one range as its lines arrive."""

    def __init__(self, file: str | int, start: int, inside: bool):
        self.file, self.start = file, start
        self.parity = int(inside)
        self.part = HEAD if inside else TAIL  # of the record that is open
        self.pending: list[str] = []  # its lines so far
        self.header = start == 0  # whether the file's first record, after blank lines, is still to come

    def take(self, lines: pa.Array) -> tuple[pa.Array, np.ndarray, bool]:
        """Records that end in ``lines``, which of them have several lines, and whether the first one is a head."""
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        after = (self.parity + np.cumsum(quotes)) & 1
        self.parity = int(after[-1])
        bounds = np.concatenate(([0], np.flatnonzero(after == 0) + 1))
        records = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lines), "\n")
        long, head = np.diff(bounds) > 1, False
        if len(records):
            if self.pending:
                opened = "\n".join([*self.pending, records[0].as_py()])
                records, long[0], self.pending = pa.concat_arrays([pa.array([opened]), records[1:]]), True, []
            head, self.part = self.part == HEAD, TAIL
        if bounds[-1] < len(lines):
            self.pending.extend(lines[int(bounds[-1]) :].to_pylist())
        return records, long, head

    def begins(self, records: pa.Array) -> np.ndarray:
        """Marks the header among records that begin in the range."""
        marks = np.zeros(len(records), bool)
        if self.header:
            shown = np.flatnonzero(pc.not_equal(records, "").to_numpy(zero_copy_only=False))
            if len(shown):
                marks[shown[0]], self.header = True, False
        return marks

    def rest(self) -> pa.RecordBatch | None:
        """What goes on in the next range."""
        if not self.pending:
            return None
        first = self.header and self.part == TAIL
        return _batch([[self.file], [self.start], [self.part], [first], ["\n".join(self.pending)]])


def _cutter(pieces: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records (or, with ``pieces``, what belongs to records across an edge) of a partition's ranges."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Range | None = None
        for batch in batches:
            for file, start, inside, lines in _runs(batch):
                if now is None or (now.file, now.start) != (file, start):
                    if now and pieces and (rest := now.rest()):
                        yield rest
                    now = _Range(file, start, inside)
                records, long, head = now.take(lines)
                if head and pieces:
                    yield _batch([[file], [start], [HEAD], [False], [records[0].as_py()]])
                yield _whole(now, records[int(head) :], long[int(head) :], pieces)
        if now and pieces and (rest := now.rest()):
            yield rest

    return cut


def _whole(now: _Range, records: pa.Array, long: np.ndarray, pieces: bool) -> pa.RecordBatch:
    """The records that lie in the range; with ``pieces`` none of them, but the header is noticed."""
    bare = pc.replace_substring_regex(records, r"\r\z", "")
    marks = now.begins(bare)
    if pieces:
        return _batch([[]] * 5)
    for record in records.filter(pa.array(long)).to_pylist():
        _check(record)
    shown = pc.not_equal(bare, "")
    kept = bare.filter(shown)
    return _batch([*([None] * len(kept),) * 3, pa.array(marks).filter(shown), kept])


def _batch(columns: list) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["file", "start", "part", "first", "record"])


def read_csv_ranges(spark: SparkSession, path: str, names: list[str], options: Mapping[str, str]) -> DataFrame:
    """The cells of CSV files with a header as texts, in columns ``names``; a file with another header raises."""
    cells = [f"c{i}" for i in range(len(names) + 1)]  # the last must stay empty in a header
    schema = ", ".join(f"{c} string" for c in cells)
    records = csv_records(spark, path).select("first", F.from_csv("record", schema, {**options}).alias("row"))
    return records.where(_not_header(names)).select(*[F.col("row")[c].alias(n) for c, n in zip(cells, names)])


def _not_header(names: list[str]) -> Column:
    def same(i: int, name: str) -> Column:
        cell = F.col("row")[f"c{i}"]
        unnamed = cell.isNull() if name == f"_c{i}" else F.lit(False)
        return F.coalesce(F.lower(cell) == name.lower(), F.lit(False)) | unnamed

    same_names = reduce(and_, [same(i, n) for i, n in enumerate(names)], F.col("row")[f"c{len(names)}"].isNull())
    wrong = F.raise_error(F.lit(f"a CSV file has another header than {','.join(names)}")).cast("boolean")
    return F.when(~F.col("first"), F.lit(True)).when(same_names, F.lit(False)).otherwise(wrong)
