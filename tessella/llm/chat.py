"""Chat formatting: tool calls are linked to their results, ordered, checked and serialised.

Calls are ``<tool_call>{"id", "name", "arguments", "depends_on"}</tool_call>`` blocks in a message; a
result is a message of role ``tool``, a JSON object with ``tool_call_id`` and ``content``.

* Linking is a hash join of calls and results on (conv_id, id). The first call, and the first
  result, of an id owns it; others are duplicates and stay unlinked.
* A call comes after the results of the calls it depends on, and a result after its call. Where
  turns contradict that, ``order_turn`` moves on to the turn of what must come before, and
  ``order_step`` counts the dependencies before it; both settle by rounds of joins. Conversations
  where calls still move after ``depth`` rounds are settled call by call: a call without open
  dependencies is ordered and frees those that wait for it. Calls that are never freed are in a
  cycle, or depend on one, and say so.
* Arguments, an object or a string that holds one, are checked against a JSON schema by tool: the keywords of CHECKED and
  BOUNDS, boolean schemas and references inside the schema, at any depth. A keyword, type, pattern or reference that is not
  known is a problem of its own (``unsupported``), never passed over.
* A message becomes one line of canonical JSON (RFC 8785): keys sorted by UTF-16, no blanks, shortest
  numbers. Whole numbers keep all their digits, which that standard would round to a double.

One row goes out per message, so no conversation, however long, is gathered in one place (but the
calls, without texts, of one whose dependencies go deeper than ``depth``);
(conv_id, order_turn, order_step, turn) sorts a conversation.

Defined cases: null text is null content; null role stays null; malformed blocks stay in the
content and count as malformed (no JSON, not-a-number and infinite values, half surrogates), which for
nesting over DEPTH levels is the problem's own name; of equal keys of an object the last counts; calls without an id and results without a call are orphans;
repeated rows give repeated messages, whose calls count once; other columns are left out.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import discard, materialise

CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
#: Levels of nesting of a call or result, at most.
DEPTH = 200
TOO_DEEP = f"nested over {DEPTH} levels"
EVENTS = "mid binary, conv_id long, turn long, k int, kind string, id string, name string, arguments string, problems array<string>, depends array<string>"


def _number(x: float) -> str:
    """The shortest decimal that reads back as ``x``, as ECMAScript writes it."""
    if x == 0:
        return "0"
    if not math.isfinite(x):
        raise ValueError(repr(x))
    mantissa, _, exponent = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) if whole != "0" else int(exponent or 0) - (len(part) - len(part.lstrip("0")))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        out = digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = f"0.{'0' * -point}{digits}"
    else:
        out = f"{digits[0]}{'.' * (n > 1)}{digits[1:]}e{point - 1:+d}"
    return "-" * (x < 0) + out


def canonical(value, depth: int = DEPTH + 10) -> str:
    if depth < 0:
        raise ValueError(TOO_DEEP)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k], depth - 1)}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(canonical(v, depth - 1) for v in value) + "]"
    return _number(value) if isinstance(value, float) else json.dumps(value, ensure_ascii=False)


def _no_number(name: str):
    raise ValueError(name)


def loads(text: str):
    """The value of a JSON text; ValueError unless its canonical form is valid too."""
    try:
        value = json.loads(text, parse_constant=_no_number)
        canonical(value, DEPTH).encode()
    except RecursionError:
        raise ValueError(TOO_DEEP) from None
    except OverflowError as e:
        raise ValueError(str(e)) from None
    return value


def _is(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "string": isinstance(value, str), "number": number, "integer": number and value == int(value), "boolean": isinstance(value, bool),
        "array": isinstance(value, list), "object": isinstance(value, dict), "null": value is None,
    }[kind]


#: Types, keywords that are checked, and keywords that say nothing about a value.
KINDS = ("string", "number", "integer", "boolean", "array", "object", "null")
CHECKED = ("type", "enum", "const", "properties", "required", "additionalProperties", "items", "anyOf", "oneOf", "allOf", "not", "pattern", "uniqueItems", "multipleOf", "$ref")
SILENT = ("title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment", "$defs", "definitions")
#: Bounds of a schema: what they measure, and whether a measure keeps the bound.
BOUNDS = {
    "minimum": ("number", lambda x, y: x >= y), "maximum": ("number", lambda x, y: x <= y), "exclusiveMinimum": ("number", lambda x, y: x > y), "exclusiveMaximum": ("number", lambda x, y: x < y),
    "minLength": ("string", lambda x, y: len(x) >= y), "maxLength": ("string", lambda x, y: len(x) <= y), "minItems": ("array", lambda x, y: len(x) >= y), "maxItems": ("array", lambda x, y: len(x) <= y),
}


def _referred(root, pointer) -> dict | bool | None:
    """What a reference inside the schema (``#/...``) stands for; None if it is none."""
    if not isinstance(pointer, str) or not pointer.startswith("#"):
        return None
    for part in [p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/")[1:]]:
        if not isinstance(root, dict) or part not in root:
            return None
        root = root[part]
    return root if isinstance(root, (dict, bool)) else None


def _whole_times(value: float, step: float) -> bool:
    return step > 0 and (Decimal(repr(value)) % Decimal(repr(step))) == 0


def problems_of(value, schema: dict | bool, at: str = "", root: dict | bool | None = None, depth: int = DEPTH) -> list[str]:
    """What is wrong with a value by its schema, as ``path: problem``; keywords that are not known say so."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    if not isinstance(schema, dict) or depth < 0:
        return [f"{at}: unsupported schema"]
    inside = lambda v, s, where=at: problems_of(v, s, where, root, depth - 1)
    out = [f"{at}: unsupported keyword {k}" for k in schema if k not in CHECKED and k not in SILENT and k not in BOUNDS]
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    out += [f"{at}: unsupported type {k}" for k in kinds if k not in KINDS]
    kinds = [k for k in kinds if k in KINDS]
    if kinds and not any(_is(value, k) for k in kinds):
        return [*out, f"{at}: no {' or '.join(kinds)}"]
    if "$ref" in schema:
        target = _referred(root, schema["$ref"])
        out += [f"{at}: unsupported reference {schema['$ref']}"] if target is None else inside(value, target)
    for allowed in [schema[k] if k == "enum" else [schema[k]] for k in ("enum", "const") if k in schema]:
        if canonical(value) not in map(canonical, allowed):
            out.append(f"{at}: not among the allowed values")
    out += [f"{at}: breaks {name} {_number(float(schema[name]))}" for name, (kind, keeps) in BOUNDS.items() if name in schema and _is(value, kind) and not keeps(value, schema[name])]
    if "multipleOf" in schema and _is(value, "number") and not _whole_times(value, schema["multipleOf"]):
        out.append(f"{at}: breaks multipleOf {_number(float(schema['multipleOf']))}")
    if "pattern" in schema and isinstance(value, str):
        try:
            out += [] if re.search(schema["pattern"], value) else [f"{at}: breaks pattern {schema['pattern']}"]
        except re.error:
            out.append(f"{at}: unsupported pattern {schema['pattern']}")
    for part in schema.get("allOf", []):
        out += inside(value, part)
    for name, right in (("anyOf", lambda n: n > 0), ("oneOf", lambda n: n == 1)):
        if name in schema and not right(sum(not inside(value, part) for part in schema[name])):
            out.append(f"{at}: breaks {name}")
    if "not" in schema and not inside(value, schema["not"]):
        out.append(f"{at}: breaks not")
    if isinstance(value, dict):
        inner, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        path = f"{at}." if at else ""
        out += [f"{path}{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in inner:
                out += inside(v, inner[k], path + k)
            elif more is False:
                out.append(f"{path}{k}: unknown")
            else:
                out += inside(v, more, path + k)
    if isinstance(value, list):
        for k, v in enumerate(value):
            out += inside(v, schema.get("items", True), f"{at}[{k}]")
        if schema.get("uniqueItems") is True and len(set(map(canonical, value))) < len(value):
            out.append(f"{at}: breaks uniqueItems")
    return out


def check(name: str | None, arguments, schemas: dict) -> list[str]:
    """What is wrong with a call's arguments, sorted."""
    if not isinstance(name, str):
        return ["no name"]
    if not isinstance(arguments, dict):
        return ["arguments are no object"]
    if name not in schemas:
        return ["no schema"] if schemas else []
    return sorted(problems_of(arguments, schemas[name]))


def parse(role: str | None, text: str | None, schemas: dict) -> tuple[str | None, list[tuple]]:
    """Content without the calls, and events (k, kind, id, name, arguments, problems, depends)."""
    if text is None:
        return None, []
    if role == "tool":
        try:
            value = loads(text)
            return canonical(value["content"]) if not isinstance(value["content"], str) else value["content"], [(0, "result", _name(value.get("tool_call_id")), None, None, [], [])]
        except (ValueError, KeyError, TypeError, AttributeError) as error:
            return text, [(0, "malformed", None, None, None, [_reason(error)], [])]
    events, kept, at = [], [], 0
    for k, m in enumerate(CALL.finditer(text)):
        try:
            value = loads(m[1])
            arguments = _arguments(value.get("arguments", {}))
            depends = [d for d in value.get("depends_on") or [] if isinstance(d, str)]
            events.append((k, "call", _name(value.get("id")), _name(value.get("name")), canonical(arguments), check(value.get("name"), arguments, schemas), sorted(set(depends))))
            kept.append(text[at : m.start()])
            at = m.end()
        except (ValueError, AttributeError, TypeError) as error:
            events.append((k, "malformed", None, None, None, [_reason(error)], []))
    return "".join([*kept, text[at:]]), events


def _arguments(value):
    """Arguments as they are, or those that a string holds as JSON, which is how they are often sent."""
    if isinstance(value, str):
        try:
            inner = loads(value)
        except ValueError:
            return value
        return inner if isinstance(inner, dict) else value
    return value


def _reason(error: Exception) -> str:
    return TOO_DEEP if str(error) == TOO_DEEP else "malformed"


def _name(value) -> str | None:
    return value if isinstance(value, str) else None


def _events_task(schemas: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(mid, conv, turn, *e) for mid, conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for e in parse(role, text, schemas)[1]]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in EVENTS.split(", ")])

    return run


ORDER = "conv_id long, id string, turn long, result_turn long, order_turn long, step int, cyclic boolean"


def _sweep(calls: pa.Table) -> pa.Table:
    """Orders the calls of one conversation, however deep their dependencies go."""
    rows = {r["id"]: r for r in calls.to_pylist()}
    waiting, open_ = {k: [] for k in rows}, {}
    for k, r in rows.items():
        depends = [d for d in r["depends"] or [] if d in rows]
        open_[k] = len(depends)
        for d in depends:
            waiting[d].append(k)
        r["order_turn"], r["step"], r["cyclic"] = r["turn"], 0, True
    free = [k for k, n in open_.items() if not n]
    while free:
        r = rows[free.pop()]
        r["cyclic"] = False
        done = max((t for t in (r["order_turn"], r["result_turn"]) if t is not None), default=None)
        for k in waiting[r["id"]]:
            after = rows[k]
            after["order_turn"] = max((t for t in (after["order_turn"], done) if t is not None), default=None)
            after["step"] = max(after["step"], r["step"] + 1)
            open_[k] -= 1
            if not open_[k]:
                free.append(k)
    kinds = {"conv_id": pa.int64(), "id": pa.string(), "turn": pa.int64(), "result_turn": pa.int64(), "order_turn": pa.int64(), "step": pa.int32(), "cyclic": pa.bool_()}
    return pa.table({name: pa.array([r[name] for r in rows.values()], kind) for name, kind in kinds.items()})


def settle(linked: DataFrame, depends: DataFrame, depth: int) -> DataFrame:
    """(conv_id, id, turn, result_turn, order_turn, step, cyclic) of linked calls."""
    now = materialise(linked.select("conv_id", "id", "turn", "result_turn", F.col("turn").alias("order_turn"), F.lit(0).alias("step"), F.lit(False).alias("cyclic")), "order")
    if depends.isEmpty():
        return now
    for _ in range(depth):
        done = now.select("conv_id", F.col("id").alias("d"), F.greatest("order_turn", F.coalesce("result_turn", "order_turn")).alias("t"), (F.col("step") + 1).alias("s"))
        need = depends.join(done, ["conv_id", "d"]).groupBy("conv_id", "id").agg(F.max("t").alias("t"), F.max("s").alias("s"))
        after = now.join(need, ["conv_id", "id"], "left").select(
            "conv_id", "id", "turn", "result_turn", F.greatest("order_turn", F.coalesce("t", "order_turn")).alias("order_turn"), F.greatest("step", F.coalesce("s", "step")).alias("step"),
            (F.coalesce("s", "step") > F.col("step")).alias("cyclic"),
        )
        before, now = now, materialise(after, "order")
        discard(before)
        if now.where("cyclic").isEmpty():
            return now
    moving = now.where("cyclic").select("conv_id").distinct()
    wanted = depends.groupBy("conv_id", "id").agg(F.collect_set("d").alias("depends"))
    deep = now.join(moving, "conv_id", "left_semi").join(wanted, ["conv_id", "id"], "left").groupBy("conv_id").applyInArrow(_sweep, ORDER)
    return materialise(now.join(moving, "conv_id", "left_anti").union(deep), "settled")


def link(messages: DataFrame, schemas: dict | None = None, depth: int = 64) -> DataFrame:
    """Calls: mid, k, id, status, result_turn, order_turn, step, cyclic; results: mid, id, status, order_turn, step."""
    schemas = schemas or {}
    tagged = F.contains(F.coalesce("text", F.lit("")), F.lit("<tool_call>")) | (F.col("role") == "tool")
    events = materialise(messages.where(tagged).select("mid", "conv_id", "turn", "role", "text").distinct().mapInArrow(_events_task(schemas), EVENTS), "events")
    place = F.struct("turn", "k", "mid")
    first = events.where("id is not null").groupBy("conv_id", "id", "kind").agg(F.min(place).alias("p"))
    calls = first.where("kind = 'call'").select("conv_id", "id", F.col("p.turn").alias("turn"), F.col("p.mid").alias("call_mid"), F.col("p.k").alias("call_k"))
    results = first.where("kind = 'result'").select("conv_id", "id", F.col("p.turn").alias("result_turn"), F.col("p.mid").alias("result_mid"))
    linked = materialise(calls.join(results, ["conv_id", "id"], "left"), "linked")
    owned = events.where("kind = 'call'").join(linked.select("conv_id", "id", F.col("call_mid").alias("mid"), F.col("call_k").alias("k")), ["conv_id", "id", "mid", "k"])
    depends = owned.select("conv_id", "id", F.explode("depends").alias("d")).distinct()
    order = settle(linked, depends, depth)
    status = F.when(F.col("kind") == "malformed", "malformed").when(F.col("id").isNull(), "orphan")
    e = events.join(linked.join(order.drop("turn", "result_turn"), ["conv_id", "id"]).withColumnRenamed("turn", "call_turn"), ["conv_id", "id"], "left")
    own_call = (F.col("mid") == F.col("call_mid")) & (F.col("k") == F.col("call_k"))
    status = (
        status.when(F.col("call_mid").isNull(), "orphan")
        .when(F.col("kind") == "call", F.when(~own_call, "duplicate").when(F.col("cyclic"), "cyclic").when(F.col("result_mid").isNull(), "unanswered").otherwise("linked"))
        .otherwise(F.when(F.col("mid") == F.col("result_mid"), "linked").otherwise("duplicate"))
    )
    after = F.when((F.col("kind") == "result") & (status == "linked"), F.col("step") + 1).otherwise(F.col("step"))
    return e.select("mid", "k", "kind", "id", "name", "arguments", "problems", status.alias("status"), F.when(status.isin("linked", "unanswered", "cyclic"), F.col("order_turn")).alias("order_turn"), after.alias("step"), "result_turn", "call_turn")


FORMATTED = "conv_id long, turn long, order_turn long, order_step int, n_calls int, n_linked int, n_problems int, message string"


def _message_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, turn, role, text, events in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            events = sorted(events or [], key=lambda e: e["k"])
            message = {"role": role, "content": parse(role, text, {})[0]}
            calls = [e for e in events if e["kind"] == "call"]
            if calls:
                message["tool_calls"] = [
                    {"id": e["id"], "name": e["name"], "arguments": json.loads(e["arguments"]), "status": e["status"], "problems": e["problems"]} | ({"result_turn": e["result_turn"]} if e["status"] == "linked" else {}) for e in calls
                ]
            for e in events:
                if e["kind"] == "result":
                    message |= {"tool_call_id": e["id"], "status": e["status"]}
            later = [(e["order_turn"], e["step"] or 0) for e in events if e["order_turn"] is not None]
            when, step = max(later, default=(turn, 0))
            if turn is None or when is None or when < turn:
                when = turn
            linked = sum(e["status"] == "linked" for e in events)
            rows.append((conv, turn, when, step, len(calls), linked, sum(len(e["problems"]) for e in events), canonical(message)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FORMATTED.split(", ")])


def format_messages(conversations: DataFrame, schemas: dict | None = None, depth: int = 64) -> DataFrame:
    """One row per message (FORMATTED)."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    who = F.to_json(F.struct("conv_id", "turn", "role", F.col("text").isNull().alias("none")))
    own = own.withColumn("mid", F.unhex(F.sha2(F.concat(who, F.coalesce("text", F.lit(""))), 256)))
    events = link(own, schemas, depth).groupBy("mid").agg(F.collect_list(F.struct("k", "kind", "id", "name", "arguments", "problems", "status", "order_turn", "step", "result_turn")).alias("events"))
    return own.join(events, "mid", "left").select("conv_id", "turn", "role", "text", "events").mapInArrow(_message_task, FORMATTED)


#: Schemas of the tools of ``with_tool_calls``.
EXAMPLE_SCHEMAS = {
    "count_words": {
        "type": "object", "required": ["turn", "words", "style"], "additionalProperties": False,
        "properties": {"turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "maximum": 60}, "style": {"enum": ["short", "long"]}, "parts": {"type": "array", "maxItems": 2, "items": {"type": "number"}}},
    }
}


def with_tool_calls(conversations: DataFrame) -> DataFrame:
    """The conversations (conv_id, turn, role, text) with a call and a result for what every assistant says, as an agent would leave them.

    The table itself has plain messages. Turns are counted in fours to make room. A call of turn t has
    the id ``ct`` and, if its text has an even number of characters, depends on the call two turns before; its
    result follows, in every fourth turn it comes before its call, and if the characters are a
    multiple of seven there is none.
    """
    chars, words, turn = F.length("text"), F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1, F.col("turn")
    style = F.when(words % 5 > 0, F.when(words < 30, '"short"').when(words < 90, '"long"').otherwise('"endless"'))
    arguments = F.concat(
        F.lit('{"words": '), words, F.lit(', "turn": '), turn, F.when(words % 3 == 0, F.lit(".0")).otherwise(F.lit("")), F.coalesce(F.concat(F.lit(', "style": '), style), F.lit("")),
        F.when(chars % 4 == 0, F.lit(', "parts": [1e2, 0.50, true]')).otherwise(F.lit("")), F.lit("}"),
    )
    depends = F.when((chars % 2 == 0) & (turn >= 2), F.concat(F.lit('["c'), turn - 2, F.lit('"]'))).otherwise(F.lit("[]"))
    call = F.concat(F.lit('<tool_call>{"id": "c'), turn, F.lit('", "name": "count_words", "arguments": '), arguments, F.lit(', "depends_on": '), depends, F.lit("}</tool_call>"))
    said = conversations.select("conv_id", (turn * 4).alias("turn"), "role", F.when(F.col("role") == "assistant", F.concat("text", call)).otherwise(F.col("text")).alias("text"))
    result = F.concat(F.lit('{"tool_call_id": "c'), turn, F.lit('", "content": {"words": '), words, F.lit(', "chars": '), chars, F.lit("}}"))
    answered = conversations.where((F.col("role") == "assistant") & (chars % 7 > 0))
    results = answered.select("conv_id", F.when(turn % 4 == 3, turn * 4 - 1).otherwise(turn * 4 + 1).alias("turn"), F.lit("tool").alias("role"), result.alias("text"))
    return said.unionByName(results)


def formatted_sql() -> str:
    """``format_messages`` of ``with_tool_calls`` in SQL over the view ``conversations`` (one row for each conv_id and turn)."""
    return """
WITH RECURSIVE a AS (SELECT conv_id, turn, text, length(text) AS chars, length(text) - length(replace(text, ' ', '')) + 1 AS words, 'c' || turn AS id FROM conversations WHERE role = 'assistant'),
calls AS (SELECT *, turn * 4 AS here, CASE WHEN chars % 7 > 0 THEN CASE WHEN turn % 4 = 3 THEN turn * 4 - 1 ELSE turn * 4 + 1 END END AS result_turn, CASE WHEN chars % 2 = 0 AND turn >= 2 THEN 'c' || (turn - 2) END AS need FROM a),
linked AS (SELECT c.*, d.id AS before FROM calls c LEFT JOIN calls d ON d.conv_id = c.conv_id AND d.id = c.need),
placed AS (SELECT conv_id, id, here AS order_turn, 0 AS step, result_turn FROM linked WHERE before IS NULL
 UNION ALL SELECT l.conv_id, l.id, greatest(l.here, p.order_turn, coalesce(p.result_turn, p.order_turn)), p.step + 1, l.result_turn FROM linked l JOIN placed p ON l.conv_id = p.conv_id AND l.before = p.id),
checked AS (SELECT l.*, p.order_turn, p.step, CASE WHEN l.result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
 list_filter(['style: ' || CASE WHEN words % 5 = 0 THEN 'missing' WHEN words >= 90 THEN 'not among the allowed values' END, CASE WHEN words > 60 THEN 'words: breaks maximum 60' END, CASE WHEN chars % 4 = 0 THEN 'parts: breaks maxItems 2' END, CASE WHEN chars % 4 = 0 THEN 'parts[2]: no number' END], lambda x: x IS NOT NULL) AS problems
 FROM linked l JOIN placed p USING (conv_id, id)),
rows AS (
 SELECT conv_id, turn * 4 AS turn, turn * 4 AS order_turn, 0 AS order_step, 0 AS n_calls, 0 AS n_linked, 0 AS n_problems, '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS message FROM conversations WHERE role IS DISTINCT FROM 'assistant'
 UNION ALL SELECT conv_id, here, order_turn, step, 1, (status = 'linked')::INT, len(problems), '{"content":' || to_json(text) || ',"role":"assistant","tool_calls":[{"arguments":{' || CASE WHEN chars % 4 = 0 THEN '"parts":[100,0.5,true],' ELSE '' END
  || CASE WHEN words % 5 > 0 THEN '"style":"' || CASE WHEN words < 30 THEN 'short' WHEN words < 90 THEN 'long' ELSE 'endless' END || '",' ELSE '' END || '"turn":' || turn || ',"words":' || words || '},"id":"' || id || '","name":"count_words","problems":' || to_json(list_sort(problems))
  || CASE WHEN status = 'linked' THEN ',"result_turn":' || result_turn ELSE '' END || ',"status":"' || status || '"}]}' FROM checked
 UNION ALL SELECT conv_id, result_turn, greatest(order_turn, result_turn), step + 1, 0, 1, 0, '{"content":"{\\"chars\\":' || chars || ',\\"words\\":' || words || '}","role":"tool","status":"linked","tool_call_id":"' || id || '"}' FROM checked WHERE status = 'linked')
SELECT conv_id, turn, order_turn, order_step::INTEGER AS order_step, n_calls::INTEGER AS n_calls, n_linked::INTEGER AS n_linked, n_problems::INTEGER AS n_problems, message FROM rows"""
