import hashlib
import itertools
import random
import zlib

import duckdb
import pandas as pd
import pytest

from tessella.llm import crc, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def replayed(rows, audit):
    """(cost, lines) of an audit on rows (role, text, letter); None if it does not fit them or the grammar."""
    todo, state, cost, lines = list(rows), "", 0, []
    asked = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    for edit in audit:
        if edit == "I":
            cost, role, text = cost + 3, asked[state], ""
        else:
            if not todo:
                return None
            role, text, letter = todo.pop(0)
            if edit == "D":
                cost += 4
                continue
            if letter == "x":
                return None
            cost += 3 * letter.isupper()
            if edit == "R":
                cost, role = cost + 3, asked[state]
            elif state + role[:1] not in ("s", "u", "su", "ua", "au"):
                return None
        state = role[:1]
        lines.append(f"{role}:{text}")
    return None if todo or state not in ("", "a") else (cost, lines)


def test_every_short_signature_has_the_least_audit():
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in range(4):
        tries = ["".join(t) for size in range(n, n + 4) for t in itertools.product("DIKR", repeat=size) if size - t.count("I") == n]
        for signature in map("".join, itertools.product("suaUOx", repeat=n)):
            rows = [(names.get(x.lower(), "user"), "t", x) for x in signature]
            best = min((found[0], audit) for audit in tries if (found := replayed(rows, audit)))
            assert repair.closed(repair.solve(signature)) == best, signature


def plain(rows):
    """The report of one conversation, by dynamic programming over whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, letters, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if kind:
            faults[kind] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters.append("x" if kind in ("blank", "duplicate") else letter.upper() if kind else letter)
    best = {0: (0, "")}
    for letter in letters:
        after = {}
        for state, (cost, audit) in best.items():
            for edits, more, to in repair.moves(letter, state):
                found = (cost + more, audit + edits)
                after[to] = min(found, after.get(to, found))
        best = after
    cost, audit = min((c + 3 * len(repair.CLOSING[s]), a + repair.CLOSING[s]) for s, (c, a) in best.items())
    known = [t for t, _, _ in rows if t is not None]
    again, lines = replayed([(r[1], r[2], x) for r, x in zip(rows, letters, strict=True)], audit)
    assert again == cost
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, **faults,
        "illegal": sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def conversations(seed=3):
    """Ordinary ones, one of 900 rows, one of equal rows, ties in turn, nulls everywhere, strange roles and blanks."""
    rng = random.Random(seed)
    say = lambda: rng.choice(["Good. ", "what now?", "Stop!", "no end", "", " \t", "é!\n", "Go.", "x" * 50 + ".", f"line {rng.random()}."])
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "umpire", ""]), say()) for c in range(60) for t in range(rng.randrange(1, 12))]
    rows += [(100, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else rng.choice(["system", "tool", "user"]), say() + str(t * (rng.random() < 0.9)) + rng.choice([".", "", "!"])) for t in range(900)]
    rows += [(101, 5, "user", "Same.")] * 300
    rows += [(102, rng.choice([None, 1, 1, 7]), rng.choice(["user", "assistant", None]), rng.choice(["One.", "Two", None])) for _ in range(40)]
    rows += [(None, None, None, None), (None, 3, "user", "Who?"), (None, 3, "user", "Who?"), (103, None, "assistant", "Me.")]
    rng.shuffle(rows)
    return rows


def expected(rows):
    """The damaged rows by conversation."""
    by = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if code == 1 else "".join(x for x in text if x not in ".!?") if code == 2 else text
        by[c] += [(t, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return {c: plain(r) for c, r in by.items()}


def found(frame):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in frame.collect()}


def test_report_equals_brute_force_whatever_the_layout(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, SCHEMA)
    due = expected(rows)
    for parts in (1, 7):
        dealt = frame.repartition(parts)
        assert found(repair.report(dealt, repair.damage(dealt))) == due


def test_sql_equals_brute_force():
    rows = conversations(5)
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.sql("CREATE VIEW conversations AS SELECT * FROM given")
    out = con.sql(repair.report_sql()).fetchall()
    names = [d[0] for d in con.sql(repair.report_sql()).description]
    assert {r[0]: dict(zip(names[1:], r[1:], strict=True)) for r in out} == expected(rows)


def test_crc_in_sql():
    texts = ["", "a", "0:17", "é€😀", "x" * 200]
    con = duckdb.connect()
    for t in texts:
        assert con.execute(f"WITH {crc.crc_table_sql()} SELECT {crc.crc32_sql('?::VARCHAR')} FROM crc_table", [t] * crc.crc32_sql("?::VARCHAR").count("?")).fetchone()[0] == zlib.crc32(t.encode())


def test_repaired_rows_follow_the_grammar(spark):
    frame = spark.createDataFrame(conversations(9), SCHEMA)
    _, _, rows = repair.repair(frame)
    by = {}
    for r in sorted(rows.collect(), key=lambda r: (r.part, r.seq, r.place)):
        by.setdefault(r.conv_id, []).append(r)
    for lines in by.values():
        initials = "".join(r.role[:1] for r in lines).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2)
        assert all(r.text == "" for r in lines if r.edit == "I")


@pytest.mark.parametrize("text", [None, "", "word. " * 60_000])
def test_odd_tables(spark, text):
    rows = [(1, 0, "user", text, "x", 1), (1, 0, "user", text, "x", 1), (1, 1, "assistant", "Fine.", None, 2)]
    frame = spark.createDataFrame(rows, SCHEMA + ", node string, part int")
    assert found(repair.report(frame, repair.damage(frame))) == expected([r[:4] for r in rows])
    none = frame.limit(0)
    assert repair.report(none, repair.damage(none)).collect() == []
    assert set(found(repair.report(frame, repair.damage(none)))) == {1}
