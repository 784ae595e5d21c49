"""Repair the structure of conversations by Knuth's lightest-derivation agenda.

A repaired conversation has the role initials ``(s?(ua)+)?``.  An item is a
place in a conversation and a state of that pattern; an edit deduces one item
from another, and two neighbouring spans deduce the span of both.  Weights are
(cost, audit): the cost adds up, the audit is the edits' letters in order.  The
agenda pops the lightest item first; a deduction never makes an item lighter
than what it is made of (it costs more, or has used one more row at equal cost),
so a popped item is final and the search ends when the goal is popped.

Edits: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or
assistant turn 2; a truncated row that stays adds 1; blank and duplicate rows
must go.  Ties go to the ASCII-least audit.  The cost of an audit over given
rows is a function of its letters, and no audit of equal cost is the beginning
of another (they would differ by inserts, which cost); so the order of audits
survives joining spans on either side, and spans can be solved apart.

That is how a conversation of any length is spread: rows are range-sorted by
conversation and turn, each task solves the runs it holds in spans of
``SPAN_ROWS`` rows (one weight for every pair of states at both ends), and the
few spans of a conversation that goes over a range's edge are joined afterwards.
Texts are not needed for that; a second pass applies the audits to the sorted
rows as a stream.  What one task has of a conversation in the end is its audit
(one letter a row, which the result holds anyway) and the chain of its hash.

Edge cases: null ``conv_id``, ``turn``, ``role`` or ``text`` count as one space
where their text is asked for; null turns come first; a null ``conv_id`` is a
conversation of its own; rows of equal turn are ordered by a hash of role and
text; repeated rows are rows; a role without a first character cannot be kept;
gaps beyond 64 bits stay at the largest long; an empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpair.llm.common import stored
from textpair.session import ship_package

# Fixed by contract: costs, the damage done to rows, white space and ends of sentences.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
DAMAGES = 20
DROP, EMPTY, UNSTOP, REPEAT, USER = range(5)
SPACES = " \t\n\v\f\r"
STOPS = "[.!?]"
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

# States: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, ASKED, ANSWERED = range(4)
STATES = (START, SYSTEM, ASKED, ANSWERED)
ENDS = (START, ANSWERED)
NEXT = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
TURNS = [(before, after) for (before, role), after in NEXT.items() if role in ROLES]

SPAN_ROWS = 256
LONGEST = (1 << 63) - 1

Row = tuple[str, str]  # role initial ('' where there is none), fault ('' or b, d, t)
Weight = tuple[int, str]  # cost, audit


def deductions(rows: tuple[Row, ...], place: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """Items that one edit before the item (place, state) gives: ``place, state, cost, letter``."""
    for before, after in TURNS:
        if after == state:
            yield place, before, INSERT, "I"
    if place == 0:
        return
    initial, fault = rows[place - 1]
    yield place - 1, state, DELETE, "D"
    if fault in ("b", "d"):
        return
    extra = TRUNCATED if fault == "t" else 0
    for (before, role), after in NEXT.items():
        if after == state and role == initial:
            yield place - 1, before, KEEP + extra, "K"
    for before, after in TURNS:
        if after == state:
            yield place - 1, before, REROLE + extra, "R"


def agenda(rows: tuple[Row, ...], ends: tuple[int, ...], goals: tuple[int, ...]) -> dict[int, Weight]:
    """Lightest weights of the goal states at the first row, from any of the end states behind the last.

    Derivations are built from the right, so that audits grow by their first letter.
    """
    waiting = [(0, 0, "", len(rows), state) for state in ends]
    final: dict[tuple[int, int], Weight] = {}
    wanted = set(goals)
    while waiting and wanted:
        cost, used, audit, place, state = heapq.heappop(waiting)
        if (place, state) in final:
            continue
        final[place, state] = (cost, audit)
        if place == 0:
            wanted.discard(state)
        for at, before, more, letter in deductions(rows, place, state):
            if (at, before) not in final:
                heapq.heappush(waiting, (cost + more, len(rows) - at, letter + audit, at, before))
    return {state: final[0, state] for state in goals if (0, state) in final}


def repair_whole(rows: tuple[Row, ...]) -> Weight:
    return agenda(rows, ENDS, (START,))[START]


# Short conversations repeat each other's roles and faults; a bounded number of them is remembered.
REMEMBERED_ROWS = 16
repair_short = lru_cache(maxsize=10_000)(repair_whole)


Span = dict[tuple[int, int], Weight]


def span_of(rows: tuple[Row, ...]) -> Span:
    """The lightest weight between every pair of states around the rows."""
    return {(before, end): w for end in STATES for before, w in agenda(rows, (end,), STATES).items()}


def joined(left: Span, right: Span) -> Span:
    """Deduce the span of both from two neighbouring spans."""
    out: Span = {}
    for (a, b), (cost, audit) in left.items():
        for (c, d), (more, rest) in right.items():
            if b == c and ((a, d) not in out or cost + more <= out[a, d][0]):
                weight = (cost + more, audit + rest)
                out[a, d] = min(out.get((a, d), weight), weight)
    return out


def joined_all(spans: list[Span]) -> Span:
    """Join neighbours pairwise, so that a letter is copied log(n) times only."""
    while len(spans) > 1:
        spans = [joined(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0] if spans else {(s, s): (0, "") for s in STATES}


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the contract's damage; dropped ones stay as marks of their conversation (``gone``)."""
    key = F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))
    rows = conversations.select(
        "conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"),
        (F.crc32(F.encode(key, "utf-8")) % DAMAGES).cast("int").alias("damage"),
    )
    done = rows.select(
        "conv_id", "turn", F.when(F.col("damage") == USER, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == EMPTY, "").when(F.col("damage") == UNSTOP, F.regexp_replace("text", STOPS, ""))
        .otherwise(F.col("text")).alias("text"),
        (F.col("damage") == DROP).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == REPEAT, 2).otherwise(1))).alias("_copy"),
    )
    return done.drop("_copy")


def as_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def marked(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` (and ``gone``) with ``mark`` of role and text, own fault and a number."""
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    mark = F.unhex(F.sha2(F.encode(F.concat_ws(":", F.octet_length("role"), "role", "text"), "utf-8"), 256))
    own = F.when(end == "", "b").when(end.rlike(STOPS), "").otherwise("t")
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "gone", mark.alias("mark"), own.alias("own"),
        F.monotonically_increasing_id().alias("number"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Add ``fault``: blank, duplicate of an earlier row, truncated or none.

    Only pairs of conversation and mark that occur again are joined back.
    """
    place = F.struct(F.col("turn").isNotNull().alias("told"), "turn", "number")
    again = (
        rows.where("NOT gone").groupBy(F.col("conv_id").alias("_conv"), F.col("mark").alias("_mark"))
        .agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("mark") == F.col("_mark"))
    later = F.col("_first").isNotNull() & (F.col("_first.number") != F.col("number"))
    fault = F.when(F.col("own") == "b", "b").when(later, "d").otherwise(F.col("own"))
    return rows.join(again, same, "left").withColumn("fault", fault).drop("_conv", "_mark", "_first", "own")


COUNTS = ("blank", "duplicate", "truncated", "illegal")
WEIGHTS = "array<struct<a:int,b:int,cost:long,audit:string>>"
RUNS = (
    "task int, least long, most long, turns long, blank long, duplicate long, truncated long,"
    " illegal long, first string, last string, n long, cost long, audit string, weights " + WEIGHTS
)


class Run:
    """What a task knows of the rows it holds of one conversation."""

    def __init__(self) -> None:
        self.n = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = None
        self.first = self.last = None
        self.rows: list[Row] = []
        self.spans: list[Span] = []

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            if self.least is None:
                self.least = turn
            if turn != self.most:
                self.turns += 1
            self.most = turn
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        if self.n and self.last + initial not in LEGAL:
            self.illegal += 1
        self.first = initial if self.n == 0 else self.first
        self.last = initial
        self.n += 1
        self.rows.append((initial, fault))
        if len(self.rows) == SPAN_ROWS:
            self.spans.append(span_of(tuple(self.rows)))
            self.rows = []

    def record(self, at_edge: bool) -> dict:
        """Everything solved, or the span where neighbouring tasks may have more rows."""
        cost, audit, weights = None, None, None
        if at_edge:
            span = joined_all([*self.spans, span_of(tuple(self.rows))])
            weights = [{"a": a, "b": b, "cost": c, "audit": x} for (a, b), (c, x) in sorted(span.items())]
        elif self.spans:
            span = joined_all([*self.spans, span_of(tuple(self.rows))])
            cost, audit = min(span[START, end] for end in ENDS if (START, end) in span)
        else:
            cost, audit = (repair_short if self.n <= REMEMBERED_ROWS else repair_whole)(tuple(self.rows))
        return {
            "least": self.least, "most": self.most, "turns": self.turns,
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "first": self.first, "last": self.last, "n": self.n, "cost": cost, "audit": audit, "weights": weights,
        }


RUN_FIELDS = [
    ("task", pa.int32()), *((c, pa.int64()) for c in ("least", "most", "turns", *COUNTS)),
    ("first", pa.string()), ("last", pa.string()), ("n", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("weights", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
]


def solve_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record per conversation of a task's sorted rows; those at the task's edges stay open."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    key = None

    def out(done: list[tuple[object, dict]]) -> pa.RecordBatch:
        columns = [pa.array([k for k, _ in done], key_type)]
        for name, kind in RUN_FIELDS:
            columns.append(pa.array([task if name == "task" else r[name] for _, r in done], kind))
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", *(n for n, _ in RUN_FIELDS)])

    run, is_first, key_type = None, True, None
    for batch in batches:
        key_type = batch.column("conv_id").type
        done = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "gone"))
        for conv, turn, initial, fault, gone in zip(*columns, strict=True):
            if run is None or conv != key:
                if run is not None:
                    done.append((key, run.record(is_first)))
                    is_first = False
                run, key = Run(), conv
            if not gone:
                run.add(turn, initial, fault)
        if done:
            yield out(done)
    if run is not None:
        yield out([(key, run.record(True))])


def joined_runs(records: list[dict]) -> dict:
    """A conversation's record from those of the tasks that hold its rows, in order."""
    total = {c: sum(r[c] for r in records) for c in COUNTS}
    whole = [r for r in records if r["n"]]
    total["illegal"] += sum(x["last"] + y["first"] not in LEGAL for x, y in zip(whole, whole[1:], strict=False))
    told = [r for r in whole if r["least"] is not None]
    turns = sum(r["turns"] for r in told)
    turns -= sum(x["most"] == y["least"] for x, y in zip(told, told[1:], strict=False))
    spans = [{(w["a"], w["b"]): (w["cost"], w["audit"]) for w in r["weights"]} for r in whole]
    span = joined_all(spans)
    cost, audit = min(span[START, end] for end in ENDS if (START, end) in span)
    least, most = (told[0]["least"], told[-1]["most"]) if told else (None, None)
    return total | {"least": least, "most": most, "turns": turns, "cost": cost, "audit": audit}


def join_groups(table: pa.Table) -> pa.Table:
    records = table.sort_by("task").to_pylist()
    total = joined_runs(records)
    names = ("least", "most", "turns", *COUNTS, "cost")
    return pa.table(
        [table.column("conv_id").slice(0, 1), *(pa.array([total[c]], pa.int64()) for c in names), pa.array([total["audit"]])],
        names=["conv_id", *names, "audit"],
    )


def diagnose(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of rows with faults."""
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = rows.select(
        "conv_id", "turn", "mark", "number", F.substring("role", 1, 1).alias("initial"), "fault", "gone"
    )
    order = ["conv_id", "turn", "mark", "number"]
    solved = stored(
        narrow.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        .select("conv_id", "turn", "initial", "fault", "gone").mapInArrow(solve_runs, f"conv_id {kind}, {RUNS}"),
        "repair-runs",
    )
    columns = ["conv_id", "least", "most", "turns", *COUNTS, "cost", "audit"]
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in columns[1:-1]) + ", audit string"
    whole = solved.where("weights IS NULL").select(*columns)
    # At most two records of a task are open: the first and the last conversation of its range.
    split = solved.where("weights IS NOT NULL").groupBy("conv_id").applyInArrow(join_groups, schema)
    # Decimals, as the difference of two longs may need one bit more.
    wide = F.col("most").cast("decimal(20,0)") - F.col("least") + 1 - F.col("turns")
    gaps = F.when(F.col("least").isNull(), F.lit(0)).otherwise(F.least(wide, F.lit(LONGEST))).cast("long")
    return whole.unionByName(split).select("conv_id", gaps.alias("gaps"), *COUNTS, "cost", "audit")


def repaired_turns(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """The edits of a conversation applied: ``letter, role, text``; role and text are null for deleted rows."""
    state = START
    for letter in audit:
        if letter == "I":
            role, text = None, ""
        else:
            role, text = next(rows)
        if letter == "D":
            yield letter, None, None
            continue
        if letter != "K":
            role = ROLES["a" if state == ASKED else "u"]
        state = NEXT[state, role[0]]
        yield letter, role, text


def sorted_with_audits(rows: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, within one task as a stream."""
    audits = diagnosis.select(
        "conv_id", F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("mark"),
        F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"),
    )
    body = rows.where("NOT gone").select(
        "conv_id", F.lit(False).alias("head"), "turn", "mark", "number", "role", "text"
    )
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        audits.unionByName(body).repartition(tasks, "conv_id")
        .sortWithinPartitions("conv_id", F.col("head").desc(), "turn", "mark", "number").select("conv_id", "head", "role", "text")
    )


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, str, Iterator[tuple[str, str]]]]:
    """``conv_id, audit, rows`` of sorted batches; rows are read as they come."""
    stream = (
        row for batch in batches
        for row in zip(batch.column("conv_id"), batch.column("head"), batch.column("role"), batch.column("text"), strict=True)
    )
    conv, _, _, audit = next(stream, (None,) * 4)
    while audit is not None:
        following = []

        def rows(following=following):
            for row in stream:
                if row[1].as_py():
                    following.append(row)
                    return
                yield row[2].as_py(), row[3].as_py()

        body = rows()
        yield conv, audit.as_py(), body
        for _ in body:
            pass
        conv, _, _, audit = following[0] if following else (None,) * 4


def keys(convs: list[pa.Scalar]) -> pa.Array:
    return pa.array([c.as_py() for c in convs], convs[0].type)


def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    convs, hashes = [], []
    for conv, audit, rows in conversations_of(batches):
        digest, joint = hashlib.sha256(), b""
        for letter, role, text in repaired_turns(audit, rows):
            if letter != "D":
                digest.update(joint + f"{role}:{text}".encode())
                joint = b"\n"
        convs.append(conv)
        hashes.append(digest.hexdigest())
        if len(convs) == 10_000:
            yield pa.RecordBatch.from_arrays([keys(convs), pa.array(hashes)], names=["conv_id", "repaired_sha256"])
            convs, hashes = [], []
    if convs:
        yield pa.RecordBatch.from_arrays([keys(convs), pa.array(hashes)], names=["conv_id", "repaired_sha256"])


def turn_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "place", "edit", "role", "text"]
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        convs, *rest = zip(*out, strict=True)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([keys(convs), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], names=names)

    for conv, audit, rows in conversations_of(batches):
        for place, edit in enumerate(repaired_turns(audit, rows)):
            out.append((conv, place, *edit))
            if len(out) == 2_000:
                yield batch()
                out.clear()
    if out:
        yield batch()


def prepared(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, gone`` with faults, stored: their numbers must not change any more."""
    ship_package(rows.sparkSession)
    return with_faults(stored(marked(rows), "repair-rows"))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Diagnosis of every conversation and its edited turns.

    ``conversations`` has ``conv_id, turn, role, text``.  The diagnosis is one
    row per conversation as ``diagnose`` gives it; the turns are ``conv_id,
    place, edit, role, text``, one row per edit, with null role and text where
    a row is deleted.
    """
    rows = prepared(
        conversations.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), F.lit(False).alias("gone"))
    )
    diagnosis = stored(diagnose(rows), "repair-diagnosis")
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, place long, edit string, role string, text string"
    return diagnosis, sorted_with_audits(rows, diagnosis).mapInArrow(turn_batches, schema)


def digest(conversations: DataFrame) -> DataFrame:
    """Damage the conversations, repair them, and tell faults, cost, audit and the repaired text's hash."""
    rows = prepared(damaged(conversations))
    diagnosis = stored(diagnose(rows), "repair-diagnosis")
    kind = rows.schema["conv_id"].dataType.simpleString()
    hashes = sorted_with_audits(rows, diagnosis).mapInArrow(hash_batches, f"conv_id {kind}, repaired_sha256 string")
    hashed = hashes.withColumnRenamed("conv_id", "_conv")
    return diagnosis.join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
