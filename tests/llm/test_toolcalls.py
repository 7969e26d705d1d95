import json

import pytest

from quarry.llm import toolcalls

CALL = "conv_id long, turn long, n int, call_id string, name string, arguments string, after array<string>"
RESULT = "conv_id long, turn long, call_id string, content string"
PARAM = "array<struct<name:string,type:string,required:boolean,options:array<string>>>"


@pytest.fixture(scope="module")
def tools(spark):
    params = [("city", "string", True, []), ("days", "integer", False, []), ("unit", "string", False, ["c", "f"]), ("near", "array", False, []), ("at", "object", False, []), ("deep", "number", False, []), ("now", "boolean", False, [])]
    return spark.createDataFrame([("weather", params), ("free", [])], f"name string, params {PARAM}")


def run(spark, calls, results, tools):
    rows = toolcalls.link(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), tools).collect()
    return rows


def test_validation_and_canonical_json(spark, tools):
    arguments = {
        "ok": '{"unit":"c", "city":"Rom\\u00e9", "days":3, "deep":1.50, "now":true, "near":[1,2], "at":{"z":1,"a":2}}',
        "missing": "{}",
        "type": '{"city":5,"days":"3","near":{},"at":[],"now":1,"deep":"x"}',
        "option": '{"city":"a","unit":"k","other":1}',
        "text": "nope",
        "list": "[1]",
        "null": None,
    }
    calls = [(1, 1, i, k, "weather", a, None) for i, (k, a) in enumerate(arguments.items())] + [(1, 2, 0, "tool", "unknown", "{}", None)]
    rows = {r["call_id"]: r for r in run(spark, calls, [(1, 3, "ok", 'a "b"\n')], tools)}
    errors = {k: r["errors"] for k, r in rows.items()}
    assert errors["ok"] == [] and errors["missing"] == ["missing: city"] and errors["tool"] == ["no such tool"]
    assert errors["type"] == ["type: at", "type: city", "type: days", "type: deep", "type: near", "type: now"]
    assert errors["option"] == ["option: unit", "unknown: other"] and errors["text"] == ["not JSON"] == errors["null"] and errors["list"] == ["not an object"]
    want = {"arguments": json.loads(arguments["ok"]), "id": "ok", "name": "weather", "result": 'a "b"\n'}
    assert rows["ok"]["message"] == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(rows["text"]["message"]) == {"id": "text", "name": "weather"}


def test_links(spark, tools):
    calls = [(1, 1, 0, "a", "free", "{}", None), (1, 4, 0, "a", "free", "{}", None), (1, 5, 0, "b", "free", "{}", None), (1, 6, 0, None, "free", "{}", None), (None, 6, 0, "a", "free", "{}", None), (2, 1, 0, "a", "free", "{}", None)]
    results = [(1, 3, "a", "second"), (1, 2, "a", "first"), (1, 9, "gone", "x"), (3, 1, "a", "y"), (1, 1, None, "z")]
    rows = run(spark, calls, results, tools)
    found = sorted(((r["conv_id"], r["call_id"], r["turn"], r["status"], r["n_results"]) for r in rows), key=str)
    want = [(1, "a", 1, "linked", 2), (1, "a", 4, "repeated", 2), (1, "b", 5, "unanswered", 0), (1, None, 6, "unanswered", 0), (None, "a", 6, "unanswered", 0), (2, "a", 1, "unanswered", 0), (1, "gone", 9, "orphan", 1), (3, "a", 1, "orphan", 1), (1, None, 1, "orphan", 1)]
    assert found == sorted(want, key=str)
    assert json.loads(next(r["message"] for r in rows if r["status"] == "linked"))["result"] == "first"


def test_order_is_topological(spark, tools):
    needs = {"a": [], "b": ["e"], "c": ["b"], "d": ["a"], "e": ["d"], "f": ["zzz", "c"], "g": ["h"], "h": ["i"], "i": ["g"], "j": ["i"], "k": ["k"], "l": ["a", "a"]}
    calls = [(7, i, 0, k, "free", "{}", after) for i, (k, after) in enumerate(needs.items())]
    rows = run(spark, calls, [], tools)
    order = [r["call_id"] for r in sorted(rows, key=lambda r: (r["place"], r["step"], r["turn"], r["n"]))]
    cyclic = {r["call_id"] for r in rows if r["cyclic"]}
    assert cyclic >= {"g", "h", "i", "k"} and not cyclic & set("abcdefl")
    for k, after in needs.items():
        for need in after:
            if need in needs and k not in cyclic and need not in cyclic:
                assert order.index(need) < order.index(k), (order, need, k)
    assert [x for x in order if x in "adl"] == ["a", "d", "l"]  # what needs nothing later stays


def test_long_chains_and_nested_needs_equal_plain_python(spark, tools):
    """600 calls in reverse order, and calls with several needs, some on circles: places and steps as found by following all needs."""
    import random

    rng = random.Random(3)
    calls = [(1, i, 0, f"c{i}", "free", "{}", [f"c{i + 1}"]) for i in range(600)]
    needs = {(1, f"c{i}"): [f"c{i + 1}"] for i in range(600)}
    for conv in range(2, 40):
        for i in range(12):
            needs[conv, f"c{i}"] = [f"c{j}" for j in rng.sample(range(13), rng.choice((0, 0, 1, 1, 2, 3)))]
            calls.append((conv, i, 0, f"c{i}", "free", "{}", needs[conv, f"c{i}"]))
    rows = {(r["conv_id"], r["call_id"]): r for r in run(spark, calls, [], tools)}
    at = {(c[0], c[3]): c[1] for c in calls}
    below = {}
    for v in reversed(at):  # of chains the end first
        seen, todo = set(), [v]
        while todo:
            for n in needs[todo.pop()]:
                if (u := (v[0], n)) in at and u not in seen:
                    seen.add(u)
                    if u in below:
                        seen |= below[u]
                    else:
                        todo.append(u)
        below[v] = seen
    circle = {v for v, seen in below.items() if v in seen}
    far = {v: max((at[u] for u in seen), default=-1) for v, seen in below.items()}
    cyclic = {v for v, seen in below.items() if far[v] >= at[v] and any(far[u] == far[v] for u in seen & circle)}
    place = {v: at[v] if v in cyclic else max(at[v], far[v]) for v in at}
    assert {v for v, r in rows.items() if r["cyclic"]} == cyclic and 20 < len(cyclic)
    assert {v: r["place"]["turn"] for v, r in rows.items()} == place
    steps = {}
    for v in sorted(at, key=lambda v: len(below[v])):
        if v not in cyclic:
            inner = [u for n in needs[v] if (u := (v[0], n)) in at and u not in cyclic and place[u] == place[v] and place[u] > at[u]]
            steps[v] = 0 if place[v] == at[v] else 1 + max([0, *(steps[u] for u in inner)])
    assert {v: rows[v]["step"] for v in steps} == steps and max(steps.values()) == 599


def test_equal_rows_are_repeated(spark, tools):
    calls = [(1, 1, 0, "a", "free", "{}", None)] * 3 + [(1, 2, 0, None, "free", "{}", ["a"])] * 2
    rows = run(spark, calls, [(1, 3, "a", "x")], tools)
    assert sorted((str(r["call_id"]), r["status"]) for r in rows) == [("None", "unanswered")] * 2 + [("a", "linked")] + [("a", "repeated")] * 2


def test_messages_and_empty_tables(spark, tools):
    call = json.dumps({"tool_calls": [{"id": "x", "name": "free", "arguments": "{}"}, {"id": "y", "name": "free", "arguments": '{"b":1}', "after": ["x"]}]})
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", call), (1, 2, "tool", json.dumps({"tool_call_id": "x", "content": "done"})), (1, 3, "assistant", "prose"), (1, 4, "tool", None)]
    calls, results = toolcalls.parse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r["call_id"]: r["status"] for r in toolcalls.link(calls, results, tools).collect()}
    assert out == {"x": "linked", "y": "unanswered"}
    assert toolcalls.link(spark.createDataFrame([], CALL), spark.createDataFrame([], RESULT), tools).count() == 0
