"""Repair of conversation structure, with each signature of roles and faults solved once.

Rows of a conversation go in order of turn (null first), role and text. A row's first fault counts:
blank (no character other than the six white-space ones), duplicate (role and text seen earlier),
truncated (the last such character is none of ``.!?``). Edits give role initials ``(s?(ua)+)?``: keep 0,
give another role 3, delete 4 (a blank or duplicate row must go), insert an empty user or assistant
turn 3; a truncated row that stays adds 3. Of the cheapest edits those with the least audit
string (D, I, K, R) are taken.

1. Equal rows are one node with a count. A node is named by a 256-bit digest, so faults, order and
   edits are found without texts; the first of equal role and text is a minimum by digest.
2. Nodes are dealt by ranges of (conversation, turn, role, digest), so a long conversation lies in many
   tasks, and cut into segments of at most SEGMENT nodes. A segment is a short string: a letter a row.
3. Each distinct string is solved once by memoised recursion: cost and audit from each state of the
   grammar to each. Inserts come right before a row that stays (an insert before a deleted row is
   never the least string), so no audit is the prefix of another and ties of a whole are
   decided by those of its parts.
4. A conversation of one segment, nearly every one, has its audit from the join with the solved strings. Others
   are joined part by part: first the segments of a task, then the tasks, then back.
5. Edits are replayed on the nodes; what stays meets its text by digest.

The digest of a repaired conversation is one stream by definition: its lines pass one task in order, one at a time.

Defined cases: null role and text are one space; a null turn comes first, all rows of a null conv_id are one
conversation; repeated rows are duplicates; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.session import materialise

from .crc import crc32_sql, crc_table_sql

SPACE = " \t\n\x0b\x0c\r"
#: Nodes of a segment.
SEGMENT = 64
#: Solved strings up to which they are sent to every task; with more, a join by string is planned.
BROADCAST_SOLVED = 4000
#: States of the grammar: nothing yet, after a system, a user, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept row of an initial; after a row (or insert) of the role that a state asks for; inserts that close it.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ASKED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}


def moves(letter: str, state: int) -> list[tuple[str, int, int]]:
    """(edits, cost, state after) of one row: a letter s, u, a or o, upper case if truncated; x must go."""
    out = [("D", 4, state)]
    if letter != "x":
        extra = 3 * letter.isupper()
        for inserts, at in (("", state), ("I", ASKED[state])):
            if (at, letter.lower()) in KEPT:
                out.append((inserts + "K", 3 * len(inserts) + extra, KEPT[at, letter.lower()]))
            out.append((inserts + "R", 3 * len(inserts) + 3 + extra, ASKED[at]))
    return out


MOVES = {(letter, state): moves(letter, state) for letter in "suaoSUAOx" for state in range(4)}


def solve(signature: str) -> list[tuple[int, str] | None]:
    """(cost, audit) from each state to each, at index 4 * from + to; None if there is no way."""
    # Rows that must go change no state, so they ride on the row before.
    rows = re.findall("(.)(x*)", signature) if signature else []

    @cache
    def best(i: int, state: int) -> tuple:
        if i == len(rows):
            return tuple((0, "") if s == state else None for s in range(4))
        out: list = [None] * 4
        letter, gone = rows[i]
        for edits, cost, to in MOVES[letter, state]:
            for goal, rest in enumerate(best(i + 1, to)):
                if rest:
                    found = (cost + 4 * len(gone) + rest[0], edits + "D" * len(gone) + rest[1])
                    if out[goal] is None or found < out[goal]:
                        out[goal] = found
        return tuple(out)

    return [way for state in range(4) for way in best(0, state)]


def closed(ways: list[tuple[int, str] | None]) -> tuple[int, str]:
    """The cheapest whole conversation, closed by inserts."""
    return min((w[0] + 3 * len(CLOSING[to]), w[1] + CLOSING[to]) for to, w in enumerate(ways[:4]) if w)


def ranked(keys: list) -> list[int]:
    """Of each from-state the order of its ways by ``keys``; -1 where there is none."""
    out = [-1] * 16
    for start in range(0, 16, 4):
        for n, at in enumerate(sorted((i for i in range(start, start + 4) if keys[i] is not None), key=lambda i: keys[i])):
            out[at] = n
    return out


def joined(one: tuple, two: tuple) -> tuple[list[int], list[int]]:
    """Costs and ranks of two parts in a row."""
    costs, keys = [-1] * 16, [None] * 16
    for start in range(4):
        for goal in range(4):
            ways = [(one[0][4 * start + m] + two[0][4 * m + goal], one[1][4 * start + m], two[1][4 * m + goal]) for m in range(4) if one[0][4 * start + m] >= 0 and two[0][4 * m + goal] >= 0]
            if ways:
                costs[4 * start + goal], *order = min(ways)
                keys[4 * start + goal] = tuple(order)
    return costs, ranked(keys)


def path(parts: list[tuple], start: int, goal: int | None = None) -> list[int]:
    """States between the parts of the best way from ``start`` to ``goal``, or to the end that is cheapest to close."""
    now = {start: (0, 0)}  # cost, and the order of the strings so far
    back: list[dict[int, int]] = []
    for costs, ranks in parts:
        after: dict[int, tuple[int, int, int, int]] = {}
        for state, (cost, order) in now.items():
            for to in range(4):
                if costs[4 * state + to] >= 0:
                    found = (cost + costs[4 * state + to], order, ranks[4 * state + to], state)
                    after[to] = min(found, after.get(to, found))
        back.append({to: x[3] for to, x in after.items()})
        places = {key: n for n, key in enumerate(sorted(x[1:3] for x in after.values()))}
        now = {to: (x[0], places[x[1:3]]) for to, x in after.items()}
    if goal is None:
        # Equal costs: the lesser string so far decides, for inserts at the end come after all of it.
        goal = min((cost + 3 * len(CLOSING[s]), order, s) for s, (cost, order) in now.items())[2]
    states = [goal]
    for step in reversed(back):
        states.append(step[states[-1]])
    return states[::-1]


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, and how often each is there (``copies``)."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("code")).where("code <> 0").select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _named(rows: DataFrame) -> DataFrame:
    """Rows with the digest of the node; a JSON object ends where it ends, so nothing is ambiguous."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    plain = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return plain.withColumn("node", F.unhex(F.sha2(F.concat(F.to_json(F.struct("conv_id", "turn", "role")), "text"), 256)))


def nodes(rows: DataFrame) -> DataFrame:
    """One row per node: conv_id, turn, role, text_digest, node, n, blank, open, first; a written table without texts."""
    named = _named(rows).withColumns({
        "text_digest": F.unhex(F.sha2("text", 256)),
        "blank": F.length(F.btrim("text", F.lit(SPACE))) == 0,
        "open": ~F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1).isin(".", "!", "?"),
    })
    every = materialise(named.groupBy("node", "conv_id", "turn", "role", "text_digest", "blank", "open").agg(F.sum("copies").alias("n")), "nodes")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = every.groupBy("conv_id", "role", "text_digest").agg(F.min_by("node", order).alias("node")).select("node", F.lit(True).alias("first"))
    marked = every.join(first, "node", "left").withColumn("first", F.coalesce("first", F.lit(False)) & ~F.col("blank"))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letters = F.when(F.col("first"), F.concat(F.when(F.col("open"), F.upper(letter)).otherwise(letter), F.repeat(F.lit("x"), (F.col("n") - 1).cast("int")))).otherwise(F.repeat(F.lit("x"), F.col("n").cast("int")))
    return materialise(marked.withColumns({"initial": letter, "letters": letters}), "nodes")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted nodes as segments, cut at batches too; ``whole`` if the conversation is known to begin and end here."""
    part, seq, before = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.num_rows
        conv = batch.column(0)
        code = np.asarray(conv.dictionary_encode("encode").indices)
        fresh = np.ones(rows, dtype=bool)
        fresh[1:] = code[1:] != code[:-1]
        heads = np.flatnonzero(fresh)
        inside = np.arange(rows) - np.repeat(heads, np.diff(np.append(heads, rows)))
        cut = np.flatnonzero(inside % SEGMENT == 0)
        stop = np.append(cut[1:], rows)
        starts = fresh[cut]
        starts[0] &= before is not None and before != (conv[0].as_py(),)
        ends = np.append(fresh[cut[1:]], False)
        n = np.asarray(batch.column(4))
        initials = np.array(batch.column(3).to_pylist())
        pairs = np.char.add(initials[:-1], initials[1:])
        bad = n - 1
        bad[1:] += ~np.isin(pairs, list(LEGAL)) & ~np.isin(np.arange(1, rows), cut)
        at = pa.array(np.append(cut, rows).astype(np.int32))
        letters = batch.column(2)
        signature = ["".join(letters.slice(a, b - a).to_pylist()) for a, b in zip(cut, stop, strict=True)]
        yield pa.RecordBatch.from_arrays([
            conv.take(pa.array(cut)), pa.array(np.full(len(cut), part, dtype=np.int32)), pa.array(np.arange(seq, seq + len(cut))), pa.array(signature), pa.array(starts & ends),
            pa.array(initials[cut].tolist()), pa.array(initials[stop - 1].tolist()), pa.array(np.add.reduceat(bad, cut)),
            pa.ListArray.from_arrays(at, batch.column(1)), pa.ListArray.from_arrays(at, batch.column(5)), pa.ListArray.from_arrays(at, batch.column(4)),
        ], names=["conv_id", "part", "seq", "signature", "whole", "head", "tail", "illegal", "nodes", "roles", "counts"])
        seq += len(cut)
        before = (conv[rows - 1].as_py(),)


def _solve_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ways = [solve(s) for s in batch.column(0).to_pylist()]
        total = [closed(w) for w in ways]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([t[0] for t in total], pa.int64()), pa.array([t[1] for t in total], pa.string()),
            pa.array([[x[0] if x else -1 for x in w] for w in ways], pa.list_(pa.int64())), pa.array([ranked([x and x[1] for x in w]) for w in ways], pa.list_(pa.int64())), pa.array([[x and x[1] for x in w] for w in ways], pa.list_(pa.string())),
        ], names=["signature", "cost", "audit", "costs", "ranks", "audits"])


SOLVED = "signature string, cost long, audit string, costs array<long>, ranks array<long>, audits array<string>"


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """(key, rows) of sorted rows, a run at a time; the rows of a run must be read before the next."""
    rows = (r for batch in batches for r in batch.to_pylist())
    yield from groupby(rows, key=lambda r: tuple(r[n] for n in names))


def _up(schema: pa.Schema):
    """Segments of a task to one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, part), rows in _groups(batches, ["conv_id", "part"]):
            total, head, tail = None, None, None
            for r in rows:
                own = (r["costs"], r["ranks"])
                total, head, tail = own if total is None else joined(total, own), head or r["head"], r["tail"]
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "part": part, "costs": total[0], "ranks": total[1], "head": head, "tail": tail}], schema=schema)

    return run


def _across(schema: pa.Schema):
    """Where each part of a conversation starts and ends, and the initial before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), rows in _groups(batches, ["conv_id"]):
            parts = list(rows)
            states = path([(r["costs"], r["ranks"]) for r in parts], START)
            yield pa.RecordBatch.from_pylist([
                {"conv_id": conv, "part": r["part"], "begin": states[i], "goal": states[i + 1], "before": parts[i - 1]["tail"] if i else None, "closing": CLOSING[states[-1]] if i == len(parts) - 1 else ""} for i, r in enumerate(parts)
            ], schema=schema)

    return run


def _down(schema: pa.Schema):
    """The audit of each segment of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, part), rows in _groups(batches, ["conv_id", "part"]):
            own = list(rows)
            states = path([(r["costs"], r["ranks"]) for r in own], own[0]["begin"], own[0]["goal"])
            out, before = [], own[0]["before"]
            for i, r in enumerate(own):
                way, closing = 4 * states[i] + states[i + 1], own[0]["closing"] if i == len(own) - 1 else ""
                out.append({"conv_id": conv, "part": part, "seq": r["seq"], "state": states[i], "audit": r["audits"][way] + closing, "cost": r["costs"][way] + 3 * len(closing), "illegal": r["illegal"] + (before is not None and before + r["head"] not in LEGAL)})
                before = r["tail"]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _typed(conv: T.DataType, rest: str) -> tuple[T.StructType, pa.Schema]:
    schema = T.StructType([T.StructField("conv_id", conv), *T._parse_datatype_string(rest).fields])
    return schema, to_arrow_schema(schema)


def audits(cut: DataFrame) -> DataFrame:
    """Of each segment (conv_id, part, seq): state before it, audit, cost, illegal; a written table."""
    spark, conv = cut.sparkSession, cut.schema["conv_id"].dataType
    solved = materialise(cut.select("signature").distinct().mapInArrow(_solve_task, SOLVED), "solved")
    small = solved.limit(BROADCAST_SOLVED + 1).count() <= BROADCAST_SOLVED
    both = cut.drop("nodes", "roles", "counts").join(F.broadcast(solved) if small else solved, "signature")
    shown = ["conv_id", "part", "seq", "state", "audit", "cost", "illegal"]
    whole = both.where("whole").withColumn("state", F.lit(START)).select(*shown)
    long = materialise(both.where("not whole").drop("signature", "whole", "cost", "audit"), "long")
    kind, arrow = _typed(conv, "part int, costs array<long>, ranks array<long>, head string, tail string")
    parts = long.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_up(arrow), kind)
    kind, arrow = _typed(conv, "part int, begin int, goal int, before string, closing string")
    ends = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_across(arrow), kind)
    kind, arrow = _typed(conv, "part int, seq long, state int, audit string, cost long, illegal long")
    same = long["conv_id"].eqNullSafe(ends["conv_id"]) & (long["part"] == ends["part"])
    met = long.join(ends, same).select(long["*"], "begin", "goal", "before", "closing")
    back = met.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_down(arrow), kind)
    return materialise(whole.unionByName(back.select(*shown)), "audits")


def _replay(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                state, place = r["state"], 0
                rows = [(node, role) for node, role, n in zip(r["nodes"], r["roles"], r["counts"], strict=True) for node, role in [(node, role)] + [(None, None)] * (n - 1)]
                todo = iter(rows)
                for edit in r["audit"]:
                    node, role = (None, None) if edit == "I" else next(todo)
                    if edit == "K":
                        state = KEPT.get((state, role[:1]), state)
                    elif edit in "IR":
                        state = ASKED[state]
                        role = ROLES[state]
                    if edit != "D":
                        out.append({"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "place": place, "edit": edit, "role": role, "node": node})
                        place += 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, audits by segment, repaired rows (conv_id, part, seq, place, edit, role, text)).

    (part, seq, place) orders a conversation.
    """
    conv = rows.schema["conv_id"].dataType
    every = nodes(rows)
    order = ["conv_id", "turn", "role", "text_digest"]
    kind, _ = _typed(conv, "part int, seq long, signature string, whole boolean, head string, tail string, illegal long, nodes array<binary>, roles array<string>, counts array<long>")
    ranged = every.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = materialise(ranged.select("conv_id", "node", "letters", "initial", "n", "role").mapInArrow(_segments, kind), "segments")
    found = audits(cut)
    kind, arrow = _typed(conv, "part int, seq long, place int, edit string, role string, node binary")
    edits = found.select("part", "seq", "state", "audit").join(cut, ["part", "seq"]).select("conv_id", "part", "seq", "state", "audit", "nodes", "roles", "counts")
    lines = materialise(edits.mapInArrow(_replay(arrow), kind), "lines")
    texts = _named(rows).groupBy("node").agg(F.first("text").alias("text"))
    shown = ["conv_id", "part", "seq", "place", "edit", "role", "text"]
    stay = lines.where("node is not null").join(texts, "node").select(*shown)
    return every, found, stay.unionByName(lines.where("node is null").withColumn("text", F.lit("")).select(*shown))


def _digests(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), rows in _groups(batches, ["conv_id"]):
            state, between = hashlib.sha256(), b""
            for r in rows:
                state.update(between + f"{r['role']}:{r['text']}".encode())
                between = b"\n"
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "sha": state.hexdigest()}], schema=schema)

    return run


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: faults of ``rows``, cost and audit of their repair, digest of the repaired."""
    conv = conversations.schema["conv_id"].dataType
    every, found, repaired = repair(rows)
    kind, arrow = _typed(conv, "sha string")
    digests = repaired.select("conv_id", "part", "seq", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "place").mapInArrow(_digests(arrow), kind)
    turns = every.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - F.col("first").cast("long")).otherwise(0)).alias("duplicate"),
        F.sum((F.col("first") & F.col("open")).cast("long")).alias("truncated"),
    )
    pieces = found.select("conv_id", "illegal", "cost", F.struct("part", "seq", "audit").alias("piece"))
    together = conversations.select("conv_id").distinct()
    for more in (turns, pieces, digests):
        together = together.unionByName(more, allowMissingColumns=True)
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return together.groupBy("conv_id").agg(
        none(F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"),
        *[none(F.sum(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["audit"]), "").alias("audit"),
        F.coalesce(F.max("sha"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def report_sql() -> str:
    """The same over the view ``conversations``, by a recursive query that carries the best edits to each state."""
    table = ", ".join(f"('{letter}', {state}, '{edits}', {cost}, {to}, '{','.join(ROLES[s] for s in _inserted(state, edits))}', '{ROLES[to] if edits.endswith('R') else ''}')" for (letter, state), ways in MOVES.items() for edits, cost, to in ways)
    closing = ", ".join(f"({state}, '{text}', '{','.join(ROLES[s] for s in _inserted(state, text))}')" for state, text in CLOSING.items())
    return f"""
WITH RECURSIVE {crc_table_sql()},
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM coded, range(0, 2) r(k) WHERE code <> 0 AND (k = 0 OR code = 3)),
numbered AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), '-') AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
faulty AS (SELECT *, NOT regexp_matches(text, '[^ \\t-\\r]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][ \\t-\\r]*$') AS open FROM numbered),
lettered AS (SELECT *, CASE WHEN blank OR again THEN 'x' ELSE (CASE WHEN open THEN upper(l) ELSE l END) END AS letter FROM (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS l FROM faulty)),
moves(letter, state, edits, cost, goal, inserted, given) AS (VALUES {table}),
closing(state, edits, inserted) AS (VALUES {closing}),
walk AS (SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS best FROM numbered
 UNION ALL SELECT w.c, w.i + 1, m.goal, min({{'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.edits, 'lines': w.best.lines || (CASE WHEN m.inserted = '' THEN [] ELSE [m.inserted || ':'] END) || (CASE WHEN m.edits = 'D' THEN [] ELSE [(CASE WHEN m.given = '' THEN r.role ELSE m.given END) || ':' || r.text] END)}})
 FROM walk w JOIN lettered r ON r.c = w.c AND r.i = w.i + 1 JOIN moves m ON m.letter = r.letter AND m.state = w.state GROUP BY w.c, w.i + 1, m.goal),
ends AS (SELECT c, min({{'cost': w.best.cost + 3 * length(e.edits), 'audit': w.best.audit || e.edits, 'lines': w.best.lines || (CASE WHEN e.inserted = '' THEN [] ELSE list_transform(string_split(e.inserted, ','), lambda x: x || ':') END)}}) AS best
 FROM walk w JOIN closing e USING (state) WHERE w.i = (SELECT count(*) FROM numbered n WHERE n.c = w.c) GROUP BY c),
faults AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (letter <> 'x' AND open) AS truncated, count(*) FILTER (before || l NOT IN ('su', 'ua', 'au')) AS illegal
 FROM (SELECT *, lag(l) OVER (PARTITION BY c ORDER BY i) AS before FROM lettered) GROUP BY c)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '-') AS c FROM conversations) o LEFT JOIN faults USING (c) LEFT JOIN ends USING (c)"""


def _inserted(state: int, edits: str) -> list[int]:
    out = []
    for _ in range(edits.count("I")):
        state = ASKED[state]
        out.append(state)
    return out
