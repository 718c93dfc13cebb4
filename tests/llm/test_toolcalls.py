import json
import re

import duckdb
import pandas as pd

from lodestrata.llm import toolcalls

SCHEMA = "conv_id long, turn long, role string, text string, conv string, v int"


def call(i, name="f", args=None, **more):
    return {"id": i, "name": name, "arguments": {} if args is None else args} | more


def turns(spark, rows):
    return spark.createDataFrame([(*r[:3], r[3] if r[3] is None or isinstance(r[3], str) else json.dumps(r[3]), "c", 1) for r in rows], SCHEMA)


def tools(spark):
    return spark.createDataFrame([("f", ["x"], {"x": "string", "y": "integer", "z": "array", "n": "number"}, True), ("g", [], {}, False)], "name string, required array<string>, properties map<string,string>, closed boolean")


def test_links_levels_and_validation(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", {"tool_calls": [call("a", args={"x": "s", "y": 1, "z": [1], "n": 1.5}), call("b", args={"x": 2, "q": 1}, after=["a", "gone"]), call("c", "g", "no", after=["d"]), call("d", "g", after=["c"]), call("a")]}),
        (1, 2, "tool", {"tool_call_id": "b", "content": "r"}), (1, 3, "tool", {"tool_call_id": "zz"}), (1, 4, "user", None), (1, 5, "user", "{bad"), (1, 6, "user", ""), (1, 7, "user", '{"k": 1, "k": 2}'),
        (2, 1, "assistant", {"tool_calls": [call("a", "unknown"), call(None)]}), (2, 2, "tool", {"tool_call_id": "a"}), (2, 2, "tool", {"tool_call_id": "a"}), (None, 1, "assistant", {"tool_calls": [call("a")]}), (None, 2, "tool", {"tool_call_id": "a"}),
        (3, 1, "assistant", {"tool_calls": [call(f"k{i}", after=[f"k{i - 1}"] if i else []) for i in range(6)]}),
    ]
    df = turns(spark, rows)
    got = toolcalls.link_calls(df, tools(spark)).collect()
    by = {(r.conv_id, r.turn, r.item): r for r in got}
    state = lambda *k: (by[k].status, by[k].level, by[k].valid, by[k].problems)
    assert state(1, 1, 1) == ("unanswered", 0, True, "") and state(1, 1, 2) == ("answered", 2, False, "type x,unknown q")
    assert state(1, 1, 3) == ("cyclic", None, False, "not an object") and state(1, 1, 4)[0] == "cyclic" and state(1, 1, 5) == ("duplicate", None, False, "missing x")
    assert (by[1, 2, 0].status, by[1, 2, 0].level, by[1, 2, 0].name) == ("linked", 3, "f") and by[1, 3, 0].status == "orphan"
    assert state(2, 1, 1) == ("answered", 0, None, None) and by[2, 1, 2].status == "duplicate" and sum(r.conv_id == 2 and r.status == "linked" for r in got) == 2
    assert by[None, 1, 1].status == "duplicate" and by[None, 2, 0].status == "orphan"
    assert [by[3, 1, i].level for i in range(1, 7)] == [0, 2, 4, 6, 8, 10]
    assert len(got) == len(rows) + 5 + 2 + 1 + 6 and json.loads(by[1, 4, 0].json) == {"content": None, "role": "user"}
    assert by[1, 1, 1].json == '{"arguments":{"n":1.5,"x":"s","y":1,"z":[1]},"id":"a","name":"f"}'


def test_empty_and_native(spark, capsys):
    df = turns(spark, [(1, 0, "user", "hi")])
    assert toolcalls.link_calls(df.limit(0)).count() == 0
    toolcalls.link_calls(df).explain()
    assert not re.search("Python|Pandas|ArrowEval", capsys.readouterr().out)


def test_query_equals_its_sql_with_every_status(spark):
    from lodestrata.llm import queries

    rows = [(c, t, ("system" if t == 0 and c % 6 == 0 else "user" if (t + (c % 6 == 0)) % 2 == 0 else "assistant"), f'text "{c}"\n\\{t} é\t世') for c in range(160) for t in range(c % 8 + 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = toolcalls.link_calls(toolcalls.derived_calls(df), toolcalls.derived_tools(spark)).toPandas()
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    want = con.sql(queries.ORACLE["op5_tool_calls"]).df()
    key = lambda f: sorted(repr([None if pd.isna(x) else int(x) if isinstance(x, float) else x for x in r]) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert key(got) == key(want)
    assert set(got.status.dropna()) == {"answered", "unanswered", "cyclic", "duplicate", "linked", "orphan"} and set(got.valid.dropna()) == {True, False}
    assert got.level.max() >= 6


def test_a_very_long_text_and_a_long_chain(spark):
    rows = [(1, 0, "assistant", {"tool_calls": [call(f"k{i}", "g", after=[f"k{i - 1}"]) for i in range(12)], "content": "x" * 500_000})]
    got = toolcalls.link_calls(turns(spark, rows)).collect()
    assert sorted(r.level for r in got if r.kind == "call") == list(range(0, 24, 2)) and len(next(r.json for r in got if r.kind == "message")) > 500_000


def test_a_conversation_of_thousands_of_calls(spark):
    n = 3000
    ids = spark.range(n)
    one = ids.selectExpr("1L as conv_id", "id as turn", "'assistant' as role", """concat('{"tool_calls":[{"id":"k', id, '","name":"g","after":["k', id - 1, '"]}]}') as text""")
    two = ids.selectExpr("2L as conv_id", "id as turn", "'assistant' as role", """concat('{"tool_calls":[{"id":"k', id, '","name":"g","after":["k', id - 1, '","k', id - 2, '"]}]}') as text""").where("turn < 60")
    got = toolcalls.link_calls(one.union(two)).where("kind = 'call'")
    assert got.where("level = 2 * turn").count() == got.count() == n + 60
