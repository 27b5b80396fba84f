import json
import random

from hostloom.llm import tool_calls as tc

SCHEMAS = {"find": {"q": ("string", True), "n": ("integer", False)}, "sum": {"xs": ("array", True)}}


def frames(spark, calls, results=(), messages=()):
    return (spark.createDataFrame(list(calls), "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"),
            spark.createDataFrame(list(results), "conv_id long, turn long, call_id string, content string"),
            spark.createDataFrame(list(messages), "conv_id long, turn long, role string, content string"))


def rows(spark, *parts):
    return tc.linked(*frames(spark, *parts), SCHEMAS).collect()


def test_statuses(spark):
    got = rows(spark,
               [(1, 1, "a", "find", '{"q":"x"}', []), (1, 2, "a", "find", '{"q":"y"}', []), (1, 3, "b", "find", '{"q":"x"}', []),
                (1, 9, "late", "find", '{"q":"x"}', []), (1, 4, None, "find", "{}", []), (None, 1, "a", "find", '{"q":"z"}', [])],
               [(1, 2, "a", "r1"), (1, 5, "a", "r2"), (1, 6, "none", "r3"), (1, 8, "late", "r4"), (1, 7, None, None),
                (None, 2, "a", "rz")], [(1, 0, "system", None)])
    assert {(r.conv_id, r.turn, r.kind): (r.status, r.other_turn) for r in got} == {
        (1, 1, "call"): ("linked", 2), (1, 2, "call"): ("repeat", 2), (1, 3, "call"): ("unanswered", None),
        (1, 9, "call"): ("early", 8), (1, 4, "call"): ("no_id", None), (None, 1, "call"): ("linked", 2),
        (1, 2, "result"): ("linked", 1), (1, 5, "result"): ("repeat", 1), (1, 6, "result"): ("orphan", None),
        (1, 8, "result"): ("early", 9), (1, 7, "result"): ("no_id", None), (None, 2, "result"): ("linked", 1),
        (1, 0, "message"): ("message", None)}


def test_order_follows_references_and_circles_have_none(spark):
    calls = [(1, 1, "a", "find", "{}", []), (1, 2, "b", "find", "{}", ["a", "gone"]), (1, 3, "c", "find", "{}", ["a", "b"]),
             (1, 4, "x", "find", "{}", ["y"]), (1, 5, "y", "find", "{}", ["x"]), (1, 6, "z", "find", "{}", ["x", "a"]),
             (1, 7, "self", "find", "{}", ["self"]), (2, 1, "b", "find", "{}", ["a"])]
    got = {(r.conv_id, r.call_id): (r.level, r.status) for r in rows(spark, calls)}
    assert got == {(1, "a"): (0, "unanswered"), (1, "b"): (1, "unanswered"), (1, "c"): (2, "unanswered"),
                   (1, "x"): (None, "cycle"), (1, "y"): (None, "cycle"), (1, "z"): (None, "cycle"),
                   (1, "self"): (None, "cycle"), (2, "b"): (0, "unanswered")}


def test_arguments_are_checked_and_written_canonically(spark):
    bad = {'{"q":1}': "field q is no string", '{"n":2}': "missing field q", '{"q":"a","n":true}': "field n is no integer",
           '{"q":"a","zz":1}': "unknown field zz", "{bad": "arguments are no JSON", "[1]": "arguments are no object",
           '{"q":NaN}': "arguments are no JSON"}
    calls = [(1, i, f"c{i}", "find", t, []) for i, t in enumerate(bad)] + [
        (1, 100, "ok", "find", ' {"q" : "é\\n\\u0041" , "n": 2} ', []), (1, 101, "who", "other", "{}", []), (1, 102, "null", "sum", None, [])]
    got = {r.call_id: r for r in rows(spark, calls)}
    for i, text in enumerate(bad):
        assert (got[f"c{i}"].valid, got[f"c{i}"].errors) == (False, bad[text])
    assert got["who"].errors == "unknown tool other" and got["null"].errors == "missing field xs"
    assert got["ok"].valid and got["ok"].json == (
        '{"role":"assistant","tool_calls":[{"arguments":{"n":2,"q":"é\\nA"},"id":"ok","name":"find"}]}')
    for r in got.values():
        json.loads(r.json)


def test_arguments_that_json_can_hold_and_columns_cannot(spark):
    deep = '{"q":' + "[" * 3000 + "]" * 3000 + "}"
    bad = {'{"n":1e400}': "arguments hold a number out of range", '{"q":"\\ud800"}': "arguments hold half a surrogate pair",
           '{"q":' + "[" * 200_000 + "]" * 200_000 + "}": "arguments are nested too deeply", deep: "field q is no string"}
    calls = [(1, i, f"c{i}", "find", t, []) for i, t in enumerate(bad)]
    got = {r.call_id: r for r in rows(spark, calls)}
    for i, text in enumerate(bad):
        assert (got[f"c{i}"].valid, got[f"c{i}"].errors) == (False, bad[text])
    assert json.loads(got["c0"].json)["tool_calls"][0]["arguments"] == '{"n":1e400}'
    assert deep in got["c3"].json


def test_calls_with_one_id_in_one_turn(spark):
    got = rows(spark, [(1, 1, "a", "find", '{"q":"x"}', []), (1, 1, "a", "sum", '{"xs":[]}', [])],
               [(1, 2, "a", "one"), (1, 2, "a", "two")])
    assert sorted((r.kind, r.status) for r in got) == [
        ("call", "linked"), ("call", "repeat"), ("result", "linked"), ("result", "repeat")]


def test_long_chains_take_few_rounds(spark):
    n = 10_000
    calls = spark.range(n).selectExpr("1L AS conv_id", "concat('c', id) AS call_id",
                                      "CASE WHEN id = 0 THEN array() ELSE array(concat('c', id - 1)) END AS after")
    circle = spark.range(50).selectExpr("2L", "concat('r', id)", "array(concat('r', (id + 1) % 50))")
    got = {(r.conv_id, r.call_id): r.level for r in tc.levels(calls.union(circle)).collect()}
    assert got == {(1, f"c{i}"): i for i in range(n)}


def test_levels_equal_longest_paths(spark):
    rng = random.Random(6)
    calls = []
    for conv in range(8):
        for i in range(25):
            refs = rng.sample(range(25), rng.choice([0, 1, 1, 1, 2, 3])) if rng.random() < 0.15 else (
                rng.sample(range(i), min(i, rng.choice([0, 1, 1, 1, 2, 3]))))
            calls.append((conv if conv else None, f"c{i}", [f"c{r}" for r in refs] + ["gone"] * (i % 2)))
    after = {(conv, call): [r for r in refs if r != "gone"] for conv, call, refs in calls}

    def level(node, path=()):
        if node in path:
            return None
        found = [level((node[0], r), (*path, node)) for r in after[node]]
        return None if None in found else 1 + max(found, default=-1)

    want = {n: level(n) for n in after}
    df = spark.createDataFrame(calls, "conv_id long, call_id string, after array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in tc.levels(df).collect()}
    assert got == {n: v for n, v in want.items() if v is not None} and len(got) < len(want)


def test_canonical_numbers_and_key_order():
    assert tc.canonical({"b": 1.0, "a": [True, None, 0.5], "é": {}, "\U0001F600": 1, "ﬀ": 2}) == (
        '{"a":[true,null,0.5],"b":1,"é":{},"\U0001F600":1,"ﬀ":2}')


def test_marked_messages(spark):
    rows = spark.createDataFrame([
        (1, 0, "assistant", 'Look <tool_call>{"id":"a","name":"find","arguments":{"q":"x"},"after":["z"]}</tool_call> and '
                            '<tool_call> {"id":"b","name":"sum"} </tool_call>'),
        (1, 1, "tool", '{"tool_call_id":"a","content":"found"}'), (1, 2, "assistant", None), (1, 3, "tool", "bad")],
        "conv_id long, turn long, role string, text string")
    calls = {(r.call_id, r.name, r.arguments, tuple(r.after)) for r in tc.marked_calls(rows).collect()}
    assert calls == {("a", "find", '{"q":"x"}', ("z",)), ("b", "sum", None, ())}
    assert {(r.call_id, r.content) for r in tc.marked_results(rows).collect()} == {("a", "found"), (None, None)}


def test_many_uses_of_one_id_and_empty_tables(spark):
    got = rows(spark, [(1, i, "a", "find", "{}", []) for i in range(300)], [(1, i, "a", "r") for i in range(300)])
    assert len(got) == 600 and sum(r.status == "linked" for r in got) == 2
    assert rows(spark, []) == []
