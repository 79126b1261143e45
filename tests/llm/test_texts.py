import hashlib
import itertools
import json
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessella.llm import chat, fingerprints, licenses, pieces

from . import cases

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())


def test_sliding_entropies_equal_brute_force():
    data = np.frombuffer("".join(t or "" for _, t in cases.corpus()[:20]).encode()[:3000] + b"\0" * 100, dtype=np.uint8)
    w = fingerprints.WINDOW
    expected = [1000 * entropy(bytes(data[i : i + w])) / math.log2(w) for i in range(len(data) - w + 1)]
    assert np.abs(fingerprints.entropies(data) - expected).max() <= 0.51


def test_digest_of_a_text_stands_alone():
    texts = [t or "" for _, t in cases.corpus()] + ["aaaa" * 100, "é" * 50]
    together = fingerprints.digests(texts)
    for t, d in zip(texts, together, strict=True):
        assert fingerprints.to_text(*d) == fingerprints.to_text(*fingerprints.digests([t])[0])
        assert fingerprints.likeness(d, d) == pytest.approx(1.0)
        assert all(0 < n <= fingerprints.CAPACITY for n in d[1])


def test_edited_texts_are_nearer_than_others(spark):
    rng = random.Random(8)
    texts = [cases.prose(rng, 300, 10**6) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in fingerprints.edit_distances(df, ranges=7).collect()}
    for k, t in enumerate(texts):
        after = texts[k - 1]
        half = len(t) // 2
        assert out[k].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest() and out[k].n_chars == len(t)
        assert out[k].near_edited > 0.25 > 0.1 > out[k].near_next
    assert fingerprints.fingerprint(df).where("doc_id = 3").first().fingerprint == out[3].fingerprint


def test_edit_distances_odd_tables(spark):
    rows = [(3, None), (2, "abc"), (2, "abd"), (None, "q"), (None, "q"), (9, "😀é" * 10)]
    out = fingerprints.edit_distances(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in out) == sorted((str(a), len(b or "")) for a, b in rows)
    assert fingerprints.edit_distances(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    lone = fingerprints.edit_distances(spark.createDataFrame([(1, "x y")], "doc_id long, text string")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(MODEL)


def best_score(model, scores, word):
    """By plain dynamic programming over the characters."""
    best = [0.0] + [-math.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - model.longest), end):
            piece = word[start:end]
            value = scores.get(piece, model.unknown if end - start == 1 else -math.inf)
            best[end] = max(best[end], best[start] + value)
    return best[-1]


def test_viterbi_finds_the_best_cut(model):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    scores = {model.pieces[i]: library.get_score(i) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    rng = random.Random(4)
    found = {pieces.SPACE + "".join(rng.choice("thesinotrea.é漢Ж") for _ in range(n)) for n in (1, 2, 5, 9, 14) for _ in range(40)} | {pieces.SPACE * 5 + "x", "ab"}
    listed = sorted(found)
    for word, ids in zip(listed, model.encode_words(listed), strict=True):
        total, ids = 0.0, ids.tolist()
        while ids:
            if ids[0] in model.bytes_of:
                size = next(n for n in (1, 2, 3, 4) if bytes(model.bytes_of[i] for i in ids[:n]).decode("utf-8", "ignore"))
                total, ids = total + model.unknown, ids[size:]
            else:
                total, ids = total + scores[model.pieces[ids[0]]], ids[1:]
        assert total == pytest.approx(best_score(model, scores, word)), word


def test_ids_are_the_models_own(spark, data, model):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + ["  a  b ", "\tx\n\ny", "é😀 漢字", " ", "", "<s> </s> <unk>", "      x", "the" * 500]
    texts += ["".join(rng.choice("thesinotrea.é漢Ж  ") for _ in range(n)) for n in (1, 2, 5, 9, 14, 47, 48, 49, 50, 300) for _ in range(40)]
    texts += ["".join(rng.choice("thesinotrea.é漢Ж") for _ in range(n)) for n in (47, 48, 49, 300) for _ in range(40)]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), text


def test_decoding_gives_the_text_back(spark, model):
    texts = [t for _, t in cases.corpus()] + ["  a  b ", "\tx\n\ny", "é😀 漢字 ▁x▁", " ", "▁", "<s> </s> <unk>"]
    for text, ids in zip(texts, model.encode([t or "" for t in texts]), strict=True):
        assert model.decode(ids) == (text or "")
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, ids int")
    out = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    assert len(out) == len(texts) and all(r.decoded == (r.text or "") and r.n_ids == len(r.ids) for r in out)
    assert all(r.exact for r in pieces.round_trip(df, MODEL).collect())
    assert pieces.encode(df.limit(0), MODEL).count() == 0


def test_licenses(spark):
    mit = "Copyright (c) 2020 Some One\n\n" + licenses.MIT_BODY.replace(", ", " ,\n").upper()
    rows = [(1, mit), (2, "Some words.\nReleased under the MIT Licence.\nmore"), (2, "Some words.\nReleased under the MIT Licence.\nmore"), (3, "released under THE mit license!"), (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0"), (6, "nothing to see\n...\n" * 1000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    out = sorted(tuple(r) for r in licenses.scan(df).where("doc_id is not null").collect())
    assert out == [(1, "MIT", "text", "document", 1, 0), (2, "MIT", "notice", "line", 1, 2), (3, "MIT", "notice", "document", 1, 0), (3, "MIT", "notice", "line", 1, 1)]
    assert {r.license_id for r in licenses.scan(df).where("doc_id is null").collect()} == {"CC-BY-NC-4.0"}
    assert licenses.scan(df.limit(0)).count() == 0


SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "number"}, "b": {"type": "integer"}}}}


def call(id_, name="add", arguments=None, **more):
    return f"<tool_call>{json.dumps({'id': id_, 'name': name, 'arguments': arguments if arguments is not None else {'a': 1}} | more)}</tool_call>"


def test_chat_linking(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", f"see {call('c1')} and {call('c2', depends_on=['c1'])}"), (1, 2, "tool", '{"tool_call_id": "c2", "content": {"z": 1, "a": 2.5}}'),
        (1, 3, "tool", '{"tool_call_id": "c1", "content": "ok"}'), (1, 4, "assistant", call("c3", arguments={"b": 1.5, "q": 1})), (1, 5, "tool", '{"tool_call_id": "nobody", "content": ""}'),
        (1, 6, "assistant", "<tool_call>{bad</tool_call>"), (1, 7, "assistant", call("c1")), (2, 0, "assistant", call("x", depends_on=["y"]) + call("y", depends_on=["x"])),
        (3, None, None, None), (3, 1, "user", "same"), (3, 1, "user", "same"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, mid int")
    out = chat.format_messages(df, SCHEMAS, depth=6).collect()
    assert len(out) == len(rows)
    at = {(r.conv_id, r.turn): r for r in out}
    m = json.loads(at[1, 1].message)
    assert m["content"] == "see  and " and [c["status"] for c in m["tool_calls"]] == ["linked", "linked"] and [c["result_turn"] for c in m["tool_calls"]] == [3, 2]
    assert at[1, 2].message == '{"content":"{\\"a\\":2.5,\\"z\\":1}","role":"tool","status":"linked","tool_call_id":"c2"}'
    # c2 waits for the result of c1 in turn 3, so its result of turn 2 comes after it.
    assert (at[1, 2].order_turn, at[1, 3].order_turn) == (3, 3) and at[1, 2].order_step > at[1, 3].order_step
    assert json.loads(at[1, 4].message)["tool_calls"][0]["problems"] == ["a: missing", "b: no integer", "q: unknown"] and json.loads(at[1, 4].message)["tool_calls"][0]["status"] == "unanswered"
    assert json.loads(at[1, 5].message)["status"] == "orphan" and json.loads(at[1, 6].message)["content"] == "<tool_call>{bad</tool_call>"
    assert json.loads(at[1, 7].message)["tool_calls"][0]["status"] == "duplicate"
    assert {c["status"] for c in json.loads(at[2, 0].message)["tool_calls"]} == {"cyclic"}
    assert at[3, None].message == '{"content":null,"role":null}' and sum(r.conv_id == 3 and r.turn == 1 for r in out) == 2
    assert chat.format_messages(df.limit(0)).count() == 0


def test_long_chains_are_no_cycles(spark):
    rows = [(1, 2 * k, "assistant", call(f"c{k}", depends_on=[f"c{k - 1}"] if k else [])) for k in range(12)] + [(1, 2 * k + 1, "tool", json.dumps({"tool_call_id": f"c{k}", "content": ""})) for k in range(12)]
    rows += [(2, 0, "assistant", call("x", depends_on=["y"]) + call("y", depends_on=["x"]) + call("z", depends_on=["x"]) + call("free")), (2, 1, "tool", '{"tool_call_id": "free", "content": ""}')]
    out = chat.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS, depth=3).collect()
    calls = {c["id"]: (c["status"], c.get("result_turn")) for r in out for c in json.loads(r.message).get("tool_calls", [])}
    assert calls == {f"c{k}": ("linked", 2 * k + 1) for k in range(12)} | dict.fromkeys("xyz", ("cyclic", None)) | {"free": ("linked", 1)}
    assert {r.turn: (r.order_turn, r.order_step) for r in out if r.conv_id == 1 and r.turn % 2 == 0} == {2 * k: (2 * k, k) for k in range(12)}


def test_messages_without_calls_are_plain(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet")
    found = {(r.conv_id, r.turn): r for r in chat.format_messages(rows).collect()}
    for r in itertools.islice(rows.collect(), 200):
        assert found[r.conv_id, r.turn].message == json.dumps({"content": r.text, "role": r.role}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@pytest.mark.parametrize(("value", "text"), [
    (1.0, "1"), (1e16, "10000000000000000"), (1e21, "1e+21"), (1e-7, "1e-7"), (0.000001, "0.000001"), (-0.0000125, "-0.0000125"), (-1.5e-9, "-1.5e-9"), (0.1, "0.1"), (-0.0, "0"), (12345678901234567890, "12345678901234567890"),
    ({"b": [True, None], "a": 1.50}, '{"a":1.5,"b":[true,null]}'), ({"\ufb33": 1, "\U0001f600": 2, "z": 3}, '{"z":3,"\U0001f600":2,"\ufb33":1}'), ("a\"\\\x0b\n/é", '"a\\"\\\\\\u000b\\n/é"'),
])
def test_canonical_json(value, text):
    assert chat.canonical(value) == text


def test_nested_schemas():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "minItems": 1, "items": {"type": ["string", "null"], "maxLength": 2}}, "o": {"properties": {"n": {"exclusiveMinimum": 0}}, "additionalProperties": {"type": "boolean"}}, "c": {"const": 1}}}
    check = lambda arguments: chat.check("t", arguments, {"t": schema})
    assert check({"a": ["x", None], "o": {"n": 1, "m": True}, "c": 1.0}) == []
    assert check({"a": ["xyz", 1], "o": {"n": 0, "m": 0}, "c": 2}) == ["a[0]: breaks maxLength 2", "a[1]: no string or null", "c: not among the allowed values", "o.m: no boolean", "o.n: breaks exclusiveMinimum 0"]
    assert check({"a": []}) == ["a: breaks minItems 1"] and check({}) == ["a: missing"] and check([]) == ["arguments are no object"]


def test_damaged_calls_stay_in_the_content(spark):
    bad = ['{"id": "\\ud800"}', "[" * 100_000, '{"id": "x", "arguments": {"a": NaN}}', '{"arguments": 1e999}', "[" * 300 + "]" * 300, "{" * 3, '{"id": 1' + "0" * 5000 + "}", ""]
    rows = [(1, k, "assistant", f"a <tool_call>{b}</tool_call>") for k, b in enumerate(bad)] + [(2, k, "tool", b) for k, b in enumerate(bad)]
    out = chat.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()
    assert sorted((r.conv_id, r.turn, json.loads(r.message)["content"]) for r in out) == sorted((c, t, x) for c, t, _, x in rows)
    assert all(r.n_calls == r.n_linked == 0 and r.n_problems == 1 for r in out)


def ordered(calls):
    """(order_turn, step) of calls (id: turn, result turn, needs), None in or after a cycle, one call at a time."""
    done = {}
    while True:
        free = [k for k, (_, _, needs) in calls.items() if k not in done and all(n in done for n in needs if n in calls)]
        if not free:
            return {k: done.get(k) for k in calls}
        turn, _, needs = calls[free[0]]
        before = [done[n] for n in needs if n in calls]
        after = [max(done[n][0], calls[n][1] if calls[n][1] is not None else -1) for n in needs if n in calls]
        done[free[0]] = (max([turn, *after]), max([s + 1 for _, s in before], default=0))


@pytest.mark.parametrize("depth", [1, 64])
def test_linking_equals_brute_force(spark, depth):
    rng = random.Random(depth)
    rows, expected = [], {}
    for conv in range(60):
        ids = [f"c{k}" for k in range(rng.randint(1, 9))]
        calls = {}
        for i in rng.sample(ids, len(ids)):
            needs = rng.sample([*ids, "nobody"], rng.choice((0, 0, 1, 2, 2 if len(ids) > 1 else 1)))
            turn, result = rng.randrange(40), rng.choice((None, rng.randrange(40)))
            calls[i] = (turn, result, needs)
            rows.append((conv, turn, "assistant", f"{i} {call(i, depends_on=needs)}"))
            if result is not None:
                rows.append((conv, result, "tool", json.dumps({"tool_call_id": i, "content": i})))
        expected |= {(conv, k): (v, *calls[k][:2]) for k, v in ordered(calls).items()}
    out = chat.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS, depth=depth).collect()
    seen = 0
    for r in out:
        m = json.loads(r.message)
        if m["role"] == "tool":
            (order, turn, result) = expected[r.conv_id, m["tool_call_id"]]
            assert m["status"] == "linked" and r.turn == result
            assert order is None or (r.order_turn, r.order_step) == (max(order[0], result), order[1] + 1)
            continue
        (c,) = m["tool_calls"]
        order, turn, result = expected[r.conv_id, c["id"]]
        assert c["status"] == ("cyclic" if order is None else "unanswered" if result is None else "linked")
        assert order is None or (r.order_turn, r.order_step) == order
        seen += 1
    assert seen == len(expected) and None in {v[0] for v in expected.values()} and len(out) == len(rows)


def plainly_selected(raw):
    """Starts of the selected windows of one text, span by span."""
    w, n = fingerprints.WINDOW, len(raw) - fingerprints.WINDOW + 1
    if n < 2:
        return [0] if raw else []
    scores = [round(1000 * entropy(raw[i : i + w]) / math.log2(w) + 1e-9) for i in range(n)]
    usable = [fingerprints.LOWEST <= e <= fingerprints.HIGHEST for e in scores]
    rank = [1000 - abs(e - fingerprints.USUAL) if ok else 1 << 20 for e, ok in zip(scores, usable, strict=True)]
    wins = Counter(min(range(i, i + fingerprints.SPAN), key=lambda k: (rank[k], k)) for i in range(n - fingerprints.SPAN + 1))
    chosen = [k for k in range(n) if wins[k] >= fingerprints.POPULAR and usable[k]]
    return chosen or [min(range(n), key=lambda k: (rank[k], k))]


def test_selection_equals_brute_force():
    rng = random.Random(6)
    texts = ["", "a", "x" * 32, "x" * 33, "y" * 200, *[cases.prose(rng, rng.randint(1, 60)) for _ in range(40)], "".join(chr(rng.randrange(32, 126)) for _ in range(400)), "ab" * 90]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    found = fingerprints.selected(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets).tolist()
    differ = sum([x - a for x in found if a <= x < b] != plainly_selected(r) for r, a, b in zip(raw, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    assert differ <= 1  # an entropy that lies between two thousandths may be rounded either way


def test_chained_filters_equal_brute_force():
    rng = np.random.default_rng(7)
    hashes = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    hashes = np.concatenate([hashes, hashes[:300], hashes[650:], rng.integers(0, 1 << 63, 40, dtype=np.uint64)])
    plain, held = [set()], [set()]
    for h in hashes.tolist():
        if h not in held[-1] and len(held[-1]) == fingerprints.CAPACITY:
            plain.append(set())
            held.append(set())
        held[-1].add(h)
        plain[-1] |= {(h >> (11 * k)) % fingerprints.BITS for k in range(fingerprints.HASHES)}
    filters, counts = fingerprints.chain(hashes)
    assert counts.tolist() == [len(h) for h in held]
    assert [set(np.flatnonzero(np.unpackbits(f.view(np.uint8), bitorder="little")).tolist()) for f in filters] == plain


def test_edits_do_not_depend_on_the_ranges(spark):
    """Repeated ids with two texts each, null ids and clashing columns, for any number of ranges."""
    rng = random.Random(9)
    rows = [(k, cases.prose(rng, rng.randint(5, 60)), "x") for k in range(20) for _ in range(2)] + [(None, cases.prose(rng, 9), "y") for _ in range(3)] + [(5, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, place string").withColumnRenamed("place", "h").repartition(4)
    one, *others = (sorted(map(str, fingerprints.edit_distances(df, ranges=n).collect())) for n in (1, 3, 8, None))
    assert len(one) == len(rows) and all(o == one for o in others)


def test_ranges_are_balanced():
    for sizes in ([5] * 40, [1, 1000, 1, 1, 1], [0, 0, 7], [3], list(range(200))):
        for ranges in (1, 3, 8, 500):
            of = fingerprints.balanced(sizes, ranges)
            assert of[0] == 0 and all(b - a in (0, 1) for a, b in zip(of, of[1:], strict=False)) and max(of) < ranges
    sums = Counter()
    for n, r in zip([5] * 40, fingerprints.balanced([5] * 40, 8), strict=True):
        sums[r] += n
    assert set(sums.values()) == {25}


def test_licence_files_and_common_notices(spark, tmp_path):
    """Texts of a folder read at run time; wrapped and decorated notices of source files."""
    (tmp_path / "Own-1.0.txt").write_text("You may look at this work,\nbut not touch it, whilst it is warm.\n")
    (tmp_path / "Other.txt").write_text("Copyright 2020 Some One. All rights reserved.\n")
    known = licenses.known_texts(spark).unionByName(licenses.read_texts(spark, f"file://{tmp_path}"))
    wrapped = lambda t: " *  " + t.replace(". ", ".\n * ").replace(" the ", "\n * the ")
    rows = [
        (1, "YOU MAY LOOK AT THIS WORK; BUT NOT TOUCH IT WHILE IT IS WARM"), (2, "Copyright 2024 A. Person\n\n" + wrapped(licenses.APACHE_NOTICE)), (3, wrapped(licenses.GNU_NOTICE.format(what="program", name="GNU General Public License", version=3))),
        (4, "BSD 3-Clause License\n\nCopyright (c) 2021, A. Person\nAll rights reserved.\n\n" + licenses.TEXTS["BSD-3-Clause"][2]), (5, wrapped(licenses.MPL_NOTICE).replace("https", "http")), (6, licenses.UNLICENSE), (7, licenses.APACHE_NOTICE + " And more."), (8, "Copyright 2020 Some One. All rights reserved."),
    ]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).where("scope = 'document'").collect()
    assert {r.doc_id: r.license_id for r in found} == {1: "Own-1.0", 2: "Apache-2.0", 3: "GPL-3.0-or-later", 4: "BSD-3-Clause", 5: "MPL-2.0", 6: "Unlicense"}
