"""Inputs as the queries' SQL has them, and work that grows no faster than they do."""

import ast

import pytest
from pyspark.sql import functions as F

from lodestrata.lineage import cut, written
from lodestrata.operators import binding, graph, inventory, substitution
from lodestrata.plans import callgraph, callgraph_queries, finding_queries, incremental, parser_queries, scan, scan_queries  # noqa: F401
from lodestrata.plans.driver_queries import QUERIES, _t
from lodestrata.sources import cmake_model, manifests

DIR = "/root/testdata/sf0.001"


def test_references_in_constraints_reach_spark_as_written(spark):
    declared = finding_queries._relations(spark, DIR)[0]
    assert declared.where(declared.constraint_raw == "${v}").count() == _t(spark, DIR, "orders").where("o_orderkey % 7 = 1").count() > 0


def test_bindings_are_told_once_for_each_pair_of_different_declarations_and_records(spark):
    told = spark.sparkContext.accumulator(0)

    def fits(version, least):
        told.add(1)
        return None if version is None else version >= least

    declared = spark.range(300).selectExpr("id declaration", "0 project_id", "'A.b' package", "cast(id % 3 as int) least")
    locks = spark.createDataFrame([(i, 0, "a-b", None if i == 7 else 1 if i == 8 else 0) for i in range(300)] + [(400, 1, "a-b", 9)], "record int, project_id int, package string, version int")
    out = binding.bind_locks(declared, locks, F.udf(fits, "boolean")("version", "least"))
    got = {r.declaration: (r.outcome, r.record) for r in out.collect()}
    assert got == {i: ("unknown" if i % 3 == 2 else "ambiguous", None) for i in range(300)}
    assert 0 < told.value <= 4 * 9  # not 300 * 300
    only = binding.bind_locks(declared, locks.where("record in (8, 400)"), F.udf(fits, "boolean")("version", "least")).collect()
    assert {(r.declaration % 3, r.outcome, r.record) for r in only} == {(0, "bound", 8), (1, "bound", 8), (2, "none", None)}


def test_requests_join_counted_candidates(spark):
    inv = spark.createDataFrame([(1, "npm", "x"), (2, "npm", "x"), (3, "Go", "y")], "project_id int, ecosystem string, package string")
    requests = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, None)], "request int, package string")
    out = inventory.explain(inv, requests)
    assert {(r.request, r.outcome, r.n, r.project_id, r.ecosystem) for r in out.collect()} == {(1, "ambiguous", 2, None, None), (2, "ambiguous", 2, None, None), (3, "found", 1, 3, "Go"), (4, "not-found", 0, None, None), (5, "not-found", 0, None, None)}
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.rindex("Aggregate") > text.index("Join")


def test_edges_are_evaluated_once_for_all_rounds(spark):
    told = spark.sparkContext.accumulator(0)

    def step(i):
        told.add(1)
        return i + 1

    edges = spark.range(12, numPartitions=1).select(F.col("id").alias("source"), F.udf(step, "long")("id").alias("target"))
    out, settled = graph.fixpoint(edges, spark.createDataFrame([(0, "a"), (5, "b")], "node long, fact string"))
    assert settled and {(r.node, r.fact) for r in out.collect()} == {(i, "a") for i in range(13)} | {(i, "b") for i in range(5, 13)}
    assert told.value == 12  # not once a round
    names = edges.withColumnsRenamed({"source": "parent", "target": "child"})
    assert graph.reachable(names, spark.createDataFrame([(0,)], "node long")).count() == 13 and told.value == 24
    assert graph.first_paths(names, spark.createDataFrame([(0,)], "node long")).count() == 13 and told.value == 36


@pytest.mark.parametrize("name", ["parse_pyproject", "parse_js_loads", "python_calls", "npm_lock_edges"])
def test_files_of_one_small_table_are_parsed_by_many_tasks(spark, name):
    assert "RoundRobinPartitioning" in QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def test_a_scan_evaluates_its_files_once(spark):
    told = spark.sparkContext.accumulator(0)

    def text(path):
        told.add(1)
        return '{"dependencies":{"a":"1"}}' if path.endswith("json") else "import 'b'" if path.endswith("js") else "import yaml" if path.endswith("py") else "[project]\ndependencies = []\n"

    files = spark.createDataFrame([("p/package.json",), ("p/i.js",), ("p/pyproject.toml",), ("p/m.py",), ("p/notes.md",)], "path string").coalesce(1).select("path", F.udf(text, "string")("path").alias("text"))
    found = {(r.package, r.code) for r in scan.scan(files)["findings"].collect()}
    assert found == {("a", "dependency.unused"), ("a", "dependency.unpinned"), ("b", "dependency.missing"), ("pyyaml", "dependency.missing")}
    assert told.value <= 5


def test_equal_short_texts_are_parsed_once_by_a_task(spark):
    told = spark.sparkContext.accumulator(0)

    def read(text):
        told.add(1)
        return [(text, str(i)) for i in range(int(text))]  # a text that is no number is a problem

    files = spark.createDataFrame([(f"f{i}", ["2", "0", "x", None, " " * 5000 + "1"][i % 5]) for i in range(50)], "path string, text string").coalesce(1)
    rows = manifests._rows(files, "a string, b string", ["a", "b"], read).collect()
    assert sorted((r.path, r.a, r.b) for r in rows if not r.problem) == sorted([(f"f{i}", "2", b) for i in range(0, 50, 5) for b in "01"] + [(f"f{i}", " " * 5000 + "1", "0") for i in range(4, 50, 5)])
    assert {r.path for r in rows if r.problem and r.a is None and r.problem.startswith("ValueError")} == {f"f{i}" for i in range(50) if i % 5 in (2, 3)}
    assert told.value == 4 + 10  # long texts are parsed each


@pytest.mark.parametrize("name", ["npm_lock_edges", "npm_lock_v1_edges", "uv_origins"])
def test_what_files_say_is_not_broadcast_by_the_size_of_the_table_behind_them(spark, name):
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_paths_against_edges_evaluate_edges_once(spark):
    told = spark.sparkContext.accumulator(0)

    def above(i):
        told.add(1)
        return i // 2

    edges = spark.range(1, 16, numPartitions=1).select(F.udf(above, "long")("id").alias("parent"), F.col("id").alias("child"))
    ends = spark.createDataFrame([(13,), (99,)], "node long")
    rows = lambda depth: {(tuple(r.path), r.length, r.rooted, r.truncated) for r in graph.reverse_paths(edges, ends, depth).collect()}
    assert rows(9) == {((13,), 0, False, False), ((13, 6), 1, False, False), ((13, 6, 3), 2, False, False), ((13, 6, 3, 1), 3, False, False), ((13, 6, 3, 1, 0), 4, True, False), ((99,), 0, True, False)}
    assert told.value <= 2 * 15
    assert rows(2) == {((13,), 0, False, False), ((13, 6), 1, False, False), ((13, 6, 3), 2, False, True), ((99,), 0, True, False)}


def test_imports_of_python_are_found_among_statements_alone():
    text = "import a\nif x:\n    try:\n        import b as c\n    except E:\n        from d import e\n    else:\n        import f\n    finally:\n        import g\nmatch y:\n    case 1:\n        import h\nwith z as w:\n    async def k():\n        from l import m\nfor i in j:\n    pass\nelse:\n    import n\nclass O:\n    def p(q=lambda: 1): import r\n"
    module = ast.parse(text)
    kept = lambda nodes: [n.lineno for n in nodes if isinstance(n, ast.Import | ast.ImportFrom)]
    found = scan._statements(module)
    assert kept(found) == kept(ast.walk(module)) and len(kept(found)) == 9
    assert not any(isinstance(n, ast.expr) for n in found) and len(found) < len(list(ast.walk(module))) / 2


def test_a_model_of_replies_evaluates_its_files_once(spark):
    told = spark.sparkContext.accumulator(0)
    texts = {
        "index-1.json": ' \n{"objects":[{"kind":"codemodel","version":{"major":2,"minor":1},"jsonFile":"m.json"}]}', "m.json": '{"kind":"codemodel","version":{"major":2,"minor":1},"configurations":[{"name":"D","targets":[{"id":"t","name":"n","jsonFile":"t.json"},{"id":"u","name":"n","jsonFile":"u.json"}]}]}',
        "t.json": '{"id":"t","name":"n","type":"EXECUTABLE"}', "u.json": '[{"id":"u","name":"n"}]', "index-2.json": '["{}"]', "index-3.json": "{",
    }

    def text(path):
        told.add(1)
        return texts[path]

    files = spark.createDataFrame([(p,) for p in texts], "path string").coalesce(1).select("path", F.udf(text, "string")("path").alias("text"))
    found = cmake_model.model(files)
    assert {(r.id, r.kind, r.status) for r in found["targets"].collect()} == {("t", "EXECUTABLE", "reported"), ("u", None, "malformed")}
    assert {(r["index"], r.code) for r in found["problems"].collect()} == {("index-1.json", "target.malformed"), ("index-2.json", "index.malformed"), ("index-3.json", "index.malformed")}
    assert told.value <= len(texts)


def test_facts_of_calls_are_broadcast_to_no_task(spark, monkeypatch):
    plans = []

    def kept(df, *by):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, *by)

    monkeypatch.setattr(callgraph, "written", kept)
    files = spark.createDataFrame([("a.py", "class A:\n    def go(self): return self\n"), ("b.py", "import a\nclass B(a.A): pass\nB().go().go()\n")], "path string, text string")
    assert {tuple(r) for r in callgraph.reach(callgraph.facts(files))[1].collect()} == {("b", "a.A.go")}
    assert plans and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("name", ["pom_properties", "parse_pom"])
def test_facts_of_poms_are_broadcast_to_no_task(spark, monkeypatch, name):
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(manifests, "cut", lambda df: plan(df) or cut(df))
    monkeypatch.setattr(substitution, "written", lambda df: plan(df) or written(df))
    plan(QUERIES[name](spark, DIR))
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not [p for p in plans if "Broadcast" in p]
    assert "RoundRobinPartitioning" in next(p for p in plans if "MapInArrow" in p)


def test_relations_of_a_scan_and_its_update_are_broadcast_to_no_task(spark, monkeypatch):
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (scan, incremental, manifests):
        monkeypatch.setattr(module, "cut", lambda df: plan(df) or cut(df))
    plan(QUERIES["scan_update"](spark, DIR))
    assert sum("SortMergeJoin" in p for p in plans) > 10
    assert not [p for p in plans if p.count("BroadcastExchange") > p.count("LocalTableScan [module")]  # the table of known modules alone
