import json
import math
import random

import pytest

from tessella.llm import chat

#: Doubles and how ECMAScript writes them.
NUMBERS = {
    0.0: "0", -0.0: "0", 1.0: "1", -1.5: "-1.5", 123456789012345680000.0: "123456789012345680000", 1e20: "100000000000000000000", 1e21: "1e+21", 1.2345678901234568e20: "123456789012345680000", 1.5e300: "1.5e+300", 5e-324: "5e-324",
    0.1: "0.1", 1e-6: "0.000001", 1e-7: "1e-7", 1.25e-7: "1.25e-7", 0.000001234: "0.000001234", 333333333.33333329: "333333333.3333333", 9007199254740992.0: "9007199254740992", 1e23: "1e+23", -4.5e-9: "-4.5e-9", 100.0: "100", 0.5: "0.5", 1024.25: "1024.25",
}


@pytest.mark.parametrize(("value", "text"), NUMBERS.items())
def test_numbers_are_written_as_the_standard_says(value, text):
    assert chat._number(value) == text


def test_numbers_read_back():
    rng = random.Random(1)
    for _ in range(20_000):
        x = rng.choice((rng.uniform(-1, 1), rng.gauss(0, 1) * 10 ** rng.randrange(-30, 30), float(rng.randrange(10**15))))
        assert float(chat._number(x)) == x and math.isfinite(x)


CASES = [
    ({"type": "date"}, 1, ["x: unsupported type date"]), (True, 1, []), (False, 1, ["x: not allowed"]), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, 2, ["x: breaks anyOf"]), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, 4, []),
    ({"oneOf": [{"minimum": 1}, {"minimum": 3}]}, 4, ["x: breaks oneOf"]), ({"oneOf": [{"minimum": 1}, {"minimum": 3}]}, 2, []), ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, 4, ["x: breaks maximum 3"]), ({"not": {"type": "null"}}, None, ["x: breaks not"]),
    ({"pattern": "^a+$"}, "aab", ["x: breaks pattern ^a+$"]), ({"pattern": "("}, "a", ["x: unsupported pattern ("]), ({"uniqueItems": True}, [1, 1.0], ["x: breaks uniqueItems"]), ({"multipleOf": 0.1}, 0.3, []), ({"multipleOf": 2}, 3, ["x: breaks multipleOf 2"]),
    ({"$ref": "#/$defs/small"}, 9, ["x: breaks maximum 5"]), ({"$ref": "http://elsewhere"}, 9, ["x: unsupported reference http://elsewhere"]), ({"dependentRequired": {}}, 9, ["x: unsupported keyword dependentRequired"]), ({"description": "silent", "const": 2}, 2, []), ({"items": False}, [1], ["x[0]: not allowed"]),
]


@pytest.mark.parametrize(("schema", "value", "due"), CASES)
def test_keywords(schema, value, due):
    whole = {"type": "object", "properties": {"x": schema}, "$defs": {"small": {"maximum": 5}}}
    assert chat.problems_of({"x": value}, whole) == due


def test_a_schema_that_refers_to_itself_ends():
    tree = {"type": "object", "properties": {"next": {"$ref": "#"}}, "required": ["v"]}
    assert chat.problems_of({"v": 1, "next": {"next": {"v": 2}}}, tree) == ["next.v: missing"]
    assert chat.problems_of(1, {"$ref": "#"})[-1].endswith("unsupported schema")


def test_arguments_in_a_string_and_deep_ones(spark):
    call = lambda a: "<tool_call>" + json.dumps({"id": "c", "name": "t", "arguments": a}) + "</tool_call>"
    schemas = {"t": {"type": "object", "properties": {"a": True, "d": {"type": "date"}}, "additionalProperties": False}}
    deep = "[" * 300 + "]" * 300
    rows = [(1, 0, "assistant", call('{"a": 1.50}')), (2, 0, "assistant", call({"b": 1})), (3, 0, "assistant", call("[1]")), (4, 0, "assistant", f'<tool_call>{{"arguments": {deep}}}</tool_call>'), (5, 0, "assistant", call({"d": "2024"}))]
    out = {r.conv_id: json.loads(r.message) for r in chat.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()}
    assert out[1]["tool_calls"][0]["arguments"] == {"a": 1.5} and out[1]["tool_calls"][0]["problems"] == []
    assert out[2]["tool_calls"][0]["problems"] == ["b: unknown"] and out[3]["tool_calls"][0]["problems"] == ["arguments are no object"]
    assert "tool_calls" not in out[4] and chat.parse("assistant", rows[3][3], {})[1][0][5] == [chat.TOO_DEEP]
    assert out[5]["tool_calls"][0]["problems"] == ["d: unsupported type date"]
