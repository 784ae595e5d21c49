import hashlib
import itertools
import random
import re
import zlib

from textpair.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    """The contract's damage, row by row."""
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        row = (conv, turn, "user" if k == 4 else role, text)
        yield from [row] * (2 if k == 3 else 1)


def faults(rows):
    seen = set()
    for _, _, role, text in rows:
        last = text.rstrip(SPACES)[-1:]
        if not last:
            yield "b"
        elif (role, text) in seen:
            yield "d"
        else:
            yield "" if last in ".!?" else "t"
        seen.add((role, text))


def cheapest(rows, found):
    """Weights of all states after each row: all audits are built from the left, the least of each state stays."""
    def inserted(best):
        for _ in range(2):
            for (before, role), after in cr.NEXT.items():
                if role in "ua" and before in best:
                    best[after] = min(best.get(after, (99e9, "")), (best[before][0] + 2, best[before][1] + "I"))
        return best

    best = inserted({0: (0, "")})
    for (_, _, role, _), fault in zip(rows, found, strict=True):
        new = {s: (c + 3, a + "D") for s, (c, a) in best.items()}
        if fault not in ("b", "d"):
            for (before, letter), after in cr.NEXT.items():
                if before in best:
                    cost, audit = best[before][0] + (fault == "t"), best[before][1]
                    if role[:1] == letter:
                        new[after] = min(new.get(after, (99e9, "")), (cost, audit + "K"))
                    if letter in "ua":
                        new[after] = min(new.get(after, (99e9, "")), (cost + 2, audit + "R"))
        best = inserted(new)
    return min(best[s] for s in (0, 3) if s in best)


def exhaustive(rows, found):
    """Every string of edits up to three inserts."""
    results = []
    for inserts in range(4):
        for letters in itertools.product("DIKR", repeat=len(rows) + inserts):
            if letters.count("I") != inserts:
                continue
            left, cost, initials = iter(zip(rows, found, strict=True)), 0, ""
            for letter in letters:
                if letter == "I":
                    cost, initials = cost + 2, initials + "*"
                    continue
                (_, _, role, _), fault = next(left)
                cost += {"D": 3, "K": 0, "R": 2}[letter] + (fault == "t" and letter != "D")
                if letter != "D" and fault in ("b", "d"):
                    cost += 10_000
                initials += {"D": "", "K": role[:1] or "-", "R": "*"}[letter]
            tail = initials[1:] if initials.startswith("s") else initials
            want = "ua" * (len(tail) // 2)
            legal = len(tail) % 2 == 0 and all(x in ("*", y) for x, y in zip(tail, want, strict=True)) and initials != "s"
            if legal and cost < 10_000:
                results.append((cost, "".join(letters)))
    return min(results)


def brute(rows):
    out = {}
    convs = {r[0] for r in rows}
    hurt = list(damage(rows))
    for conv in convs:
        # Rows of one turn: by the hash of role and text, as the operator states.
        def order(r):
            mark = hashlib.sha256(f"{len(r[2].encode())}:{r[2]}:{r[3]}".encode()).digest()
            return (r[1] is not None, r[1] or 0, mark)

        mine = sorted((r for r in hurt if r[0] == conv), key=order)
        found = list(faults(mine))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in mine]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
        cost, audit = cheapest(mine, found)
        lines, left, sequence = [], iter(mine), ""
        for letter in audit:
            row = None if letter == "I" else next(left)
            if letter == "D":
                continue
            expected = "user" if not sequence or sequence[-1] in "sa" else "assistant"
            role = row[2] if letter == "K" else expected
            sequence += role[0]
            lines.append(f"{role}:{row[3] if row else ''}")
        assert re.fullmatch("(s?(ua)+)?", sequence)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (min(gaps, 2**63 - 1), found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, digest)
    return out


def check(spark, rows, parts=None):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS gone", "'x' AS _conv", "2 AS audit")
    got = cr.digest(df if parts is None else df.repartition(parts)).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {r.conv_id: tuple(r[n] for n in names) for r in got} == brute(rows) and len(got) == len({r[0] for r in rows})


def test_agenda_is_exhaustive_search():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(1, i, rng.choice(["user", "assistant", "system", "", "x"]), "") for i in range(rng.randrange(5))]
        found = [rng.choice(["", "", "b", "d", "t"]) for _ in rows]
        short = tuple((r[2][:1], f) for r, f in zip(rows, found, strict=True))
        assert cr.repair_whole(short) == exhaustive(rows, found) == cheapest(rows, found)


def test_spans_join_to_the_whole():
    rng = random.Random(2)
    for _ in range(40):
        rows = tuple((rng.choice("uas"), rng.choice(["", "", "", "t", "d", "b"])) for _ in range(rng.randrange(40)))
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        span = cr.joined_all([cr.span_of(p) for p in parts])
        assert min(span[0, end] for end in cr.ENDS if (0, end) in span) == cr.repair_whole(rows)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "cut", "", "  ", None, "a. ", "é. \n", "twice. Yes", "\x0b"]
    roles = ["user", "assistant", "system", "tool", "User", "", None, "unicorn"]
    rows = []
    for conv in [*range(150), None]:
        for i in range(rng.randrange(12)):
            turn = rng.choice([None, i, i, i, i + 3, 0])
            weights = [8, 8, 3, 1, 1, 1, 1, 1]
            rows.append((conv, turn, rng.choices(roles, weights)[0], rng.choice(texts) if rng.random() < 0.7 else f"text {conv} {i}."))
    rows += [(900, t, "user", "x.") for t in (-(2**63), 2**63 - 1)] + [(901, None, None, None)] * 3
    check(spark, rows, 5)


def test_one_conversation_over_all_tasks(spark):
    """A third of the rows in one conversation, and one row repeated many times."""
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["ok.", "ok", f"t{i}.", f"t{i}"])) for i in range(1500)]
    rows += [(8, 1, "user", "same.")] * 600 + [(i, t, r, f"{t}.") for i in range(100, 400) for t, r in enumerate(("user", "assistant"))]
    rng.shuffle(rows)
    check(spark, rows, 6)


def test_empty_table_and_conversations_without_rows(spark):
    assert cr.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = cr.digest(spark.createDataFrame([(dropped, 0, "user", "x.")], SCHEMA)).first()
    assert row.asDict() == {
        "conv_id": dropped, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
        "repaired_sha256": hashlib.sha256(b"").hexdigest(),
    }


def test_turns_and_very_long_text(spark):
    rows = [(1, 0, "assistant", "x" * 3_000_000 + "."), (1, 1, "assistant", "yes."), (1, 2, "assistant", "yes."), (2, 0, "system", "s.")]
    diagnosis, turns = cr.repair(spark.createDataFrame(rows, SCHEMA))
    assert {(r.conv_id, r.audit, r.cost) for r in diagnosis.collect()} == {(1, turns_audit(turns, 1), cost_of(diagnosis, 1)), (2, "D", 3)}
    got = [(r.place, r.edit, r.role, len(r.text or "")) for r in turns.where("conv_id = 1").orderBy("place").collect()]
    assert [g[1] for g in got].count("D") == 1
    kept = [g for g in got if g[1] != "D"]
    assert [g[2] for g in kept] == ["user", "assistant"] * (len(kept) // 2) and 3_000_001 in [g[3] for g in kept]


def turns_audit(turns, conv):
    return "".join(r.edit for r in turns.where(f"conv_id = {conv}").orderBy("place").collect())


def cost_of(diagnosis, conv):
    return diagnosis.where(f"conv_id = {conv}").first().cost
