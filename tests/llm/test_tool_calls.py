import json

from innings_engine.llm import tool_calls as tc

CALLS = "conv_id long, call_id string, position long, name string, arguments string, after array<string>, json string"
RESULTS = "conv_id long, call_id string, position long, content string, kind string"
SCHEMAS = [("f", "a", "integer", True), ("f", "b", "string", False), ("f", "o", "object", False), ("g", "x", "number", False), ("g", "n", "null", False)]


def run(spark, calls, results):
    rows = tc.linked(spark.createDataFrame([(*c, "x") for c in calls], CALLS), spark.createDataFrame([(*r, "x") for r in results], RESULTS),
                     spark.createDataFrame(SCHEMAS, "name string, field string, type string, required boolean")).collect()
    return {(r.conv_id, r.call_id): r for r in rows}


def test_links_orders_and_validates(spark):
    got = run(spark, [
        (1, "a", 0, "f", '{"b": "é\\n\\"", "a" : 1}', None), (1, "b", 2, "f", '{"a":"1","z":[1, {"y":2,"x":null}]}', ["a", "a"]), (1, "c", 4, "g", '{"x":1.5,"n":null}', ["b", "a", "gone"]),
        (1, "d", 6, "h", "not json", ["e"]), (1, "e", 8, "g", "[1]", ["d"]), (1, "f", 9, "f", "{}", ["e"]), (1, "g", 10, "f", None, []), (2, "a", 0, "f", '{"a":1,"o":{"k":1}}', ["a"]),
        (3, "a", 5, "g", "{}", None), (3, "a", 1, "f", '{"a":2}', None), (3, None, 1, "f", "{}", None)],
        [(1, "a", 1, "done"), (1, "a", 3, "again"), (1, "q", 3, "lost"), (1, "b", 1, None), (None, "a", 1, "x")])
    assert {k: v.level for k, v in got.items()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): None, (1, "e"): None, (1, "f"): None, (1, "g"): 0, (1, "q"): None, (2, "a"): None, (3, "a"): 0}
    assert {k: v.errors for k, v in got.items()} == {
        (1, "a"): "", (1, "b"): "type:a,unknown:z", (1, "c"): "dangling:gone", (1, "d"): "cycle,malformed,no_tool", (1, "e"): "cycle,malformed", (1, "f"): "cycle,missing:a", (1, "g"): "malformed",
        (1, "q"): "", (2, "a"): "cycle", (3, "a"): ""}
    assert got[1, "a"].json == '{"arguments":{"a":1,"b":"é\\n\\""},"id":"a","name":"f","result":"done"}' and got[1, "a"].n_results == 2
    assert got[1, "b"].json == '{"arguments":{"a":"1","z":[1,{"x":null,"y":2}]},"id":"b","name":"f","result":null}' and got[1, "b"].early
    assert got[1, "q"].kind == "orphan" and json.loads(got[1, "q"].json) == {"arguments": None, "id": "q", "name": None, "result": "lost"}
    assert got[3, "a"].n_calls == 2 and got[3, "a"].position == 1
    assert json.loads(got[1, "d"].json)["arguments"] == "not json" and json.loads(got[1, "g"].json)["arguments"] is None
    for r in got.values():
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json


def test_long_chain_and_empty(spark):
    n = 12
    got = run(spark, [(1, f"c{i}", n - i, "f", '{"a":1}', [f"c{i - 1}"] if i else None) for i in range(n)], [])
    assert [got[1, f"c{i}"].level for i in range(n)] == list(range(n))
    assert run(spark, [], []) == {} and len(run(spark, [], [(1, "a", 0, "x")])) == 1


def test_plan_is_native(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = tc.linked(tc.calls_of(turns), tc.results_of(turns), tc.schemas_of(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan
