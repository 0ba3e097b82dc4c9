from __future__ import annotations

import json

import pytest

from rowforge.llm import chat

TOOLS = {
    "add": chat.Tool(required={"a": "number", "b": "integer"}, optional={"note": "string"}),
    "list": chat.Tool(required={"items": "array", "by": "object"}),
    "none": chat.Tool(),
}


def linked(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as id", "2 as call")
    return chat.link_calls(*chat.tool_messages(turns), TOOLS).collect()


def asks(*calls):
    return json.dumps({"tool_calls": list(calls)})


def call(id_, name="none", arguments=None, needs=None):
    return {"id": id_, "name": name, "arguments": {} if arguments is None else arguments, **({"needs": needs} if needs else {})}


def answer(id_, content="ok"):
    return json.dumps({"tool_call_id": id_, "content": content})


def test_links_and_states(spark):
    rows = [
        (1, 0, "user", "question {"),
        (1, 1, "assistant", asks(call("a"), call("b"), call(None), call("a"))),
        (1, 2, "tool", answer("a", "first")),
        (1, 3, "tool", answer("a", "second")),
        (1, 4, "tool", answer("zzz")),
        (2, 1, "assistant", asks(call("a"))),
        (2, 2, "assistant", "prose"),
        (2, 3, "assistant", None),
    ]
    got = {(r["conversation"], r["turn"], r["place"]): r for r in linked(spark, rows)}
    assert {k: (r["status"], r["n_results"]) for k, r in got.items()} == {
        (1, 1, 0): ("answered", 2), (1, 1, 1): ("pending", 0), (1, 1, 2): ("unidentified", 0),
        (1, 1, 3): ("repeated", 0), (2, 1, 0): ("pending", 0),
    }
    assert json.loads(got[1, 1, 0]["message"])["result"] == {"content": "first", "turn": 2}


def order(spark, *calls):
    rows = linked(spark, [(1, 1, "assistant", asks(*calls))])
    return [r["call_id"] for r in sorted(rows, key=lambda r: r["position"])], {r["call_id"]: r for r in rows}


def test_topological_order(spark):
    ids, rows = order(spark, call("d", needs=["c", "a"]), call("c", needs=["b"]), call("b", needs=["a"]), call("a"), call("x"), call("e", needs=["gone", "x"]))
    assert sorted(ids) == ["a", "b", "c", "d", "e", "x"]
    for before, after in [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("x", "e")]:
        assert ids.index(before) < ids.index(after)
    assert rows["e"]["n_unmet"] == 1 and not any(r["cyclic"] for r in rows.values())
    # without a call that needs a later one the order stays as it is
    assert order(spark, call("b"), call("a", needs=["b"]), call("c", needs=["a", "b"]))[0] == ["b", "a", "c"]


def test_long_chains_and_cycles(spark):
    chain = [call(f"k{i}", needs=[f"k{i + 1}"]) for i in range(12)] + [call("k12")]
    assert order(spark, *chain)[0] == [f"k{i}" for i in range(12, -1, -1)]
    ids, rows = order(spark, call("p", needs=["q"]), call("q", needs=["p"]), call("r", needs=["q"]), call("s"), call("t", needs=["t"]))
    assert {k for k, r in rows.items() if r["cyclic"]} == {"p", "q", "r", "t"} and ids[0] == "s"


@pytest.mark.parametrize(
    "name, arguments, errors",
    [
        ("add", {"a": 1.5, "b": 2}, ""),
        ("add", {"a": 1, "b": 2, "note": "x"}, ""),
        ("add", {"a": "1", "b": 2.5}, "type:a type:b"),
        ("add", {"b": True}, "missing:a type:b"),
        ("add", {"a": None, "b": 1, "z": 1, "c": 1}, "type:a unknown:c unknown:z"),
        ("list", {"items": [1, "a", {}], "by": {"k": []}}, ""),
        ("list", {"items": {}, "by": []}, "type:by type:items"),
        ("none", {}, ""),
        ("none", {"x": 1}, "unknown:x"),
        ("none", [1], "not_object"),
        ("none", "text", "not_object"),
        ("other", {}, "unknown_tool"),
    ],
)
def test_arguments_are_validated(spark, name, arguments, errors):
    (row,) = linked(spark, [(1, 1, "assistant", asks({"id": "i", "name": name, "arguments": arguments}))])
    assert (row["errors"], row["valid"]) == (errors, errors == "")


def test_canonical_json(spark):
    one = '{"tool_calls": [ {"name":"add", "arguments":{"b": 2,"a":{"y":1, "x":[ 1 ,2]}}, "id":"i"} ]}'
    two = '{"tool_calls":[{"id":"i","arguments":{"a":{"x":[1,2],"y":1},"b":2},"name":"add"}]}'
    a, b = (linked(spark, [(1, 1, "assistant", t)])[0]["message"] for t in (one, two))
    assert a == b == '{"call":{"arguments":{"a":{"x":[1,2],"y":1},"b":2},"id":"i","name":"add"},"errors":["type:a"]}'


def test_hot_identifiers_do_not_multiply(spark):
    rows = [(1, 1, "assistant", asks(call("a")))] * 300 + [(1, 2, "tool", answer("a"))] * 300
    got = linked(spark, rows)
    assert len(got) == 300
    assert sorted(r["status"] for r in got) == ["answered"] + ["repeated"] * 299
    assert sorted(r["position"] for r in got) == list(range(1, 301))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(None, 1, "assistant", asks(call("a"))), (None, 2, "tool", answer("a"))]])
def test_odd_tables(spark, rows):
    got = linked(spark, rows)
    assert [r["status"] for r in got] == (["answered"] if len(rows) == 2 else [])
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert len(chat.link_calls(*chat.exchanges(turns), TOOLS).collect()) == 0


def test_no_python_runs_on_the_workers(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", asks(call("a")))], "conv_id long, turn long, role string, text string")
    plan = chat.link_calls(*chat.tool_messages(turns), TOOLS)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_schemas_are_checked():
    with pytest.raises(ValueError):
        chat.Tool(required={"a": "text"})
    with pytest.raises(ValueError):
        chat.Tool(optional={"a'b": "string"})
