import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import advisories, evidence, graph, inventory, lookup
from lodestrata.plans import reports, store
from lodestrata.sources import feeds
from lodestrata.streaming import refresh

from .test_sources import rows, write


def test_missing_and_ignored(spark):
    usages = spark.createDataFrame([("p", "NPM", "a", "runtime", "optional", "exact"), ("p", "npm", "b", "runtime", "regular", "configured"), ("p", "npm", None, "runtime", "regular", "unknown"), ("p", "npm", "c", "runtime", "regular", "inferred")], "project_id string, ecosystem string, package string, scope string, kind string, mapping_confidence string")
    declared = spark.createDataFrame([], "project_id string, ecosystem string, package string, scope string, kind string")
    own = evidence.qualified_usages(usages)
    assert rows(evidence.missing(own, evidence.eligible_declarations(declared)), "package", "severity") == [("a", "warning"), ("b", "error")]
    assert evidence.ignore(usages, spark.createDataFrame([("npm", "A")], "ecosystem string, package string")).count() == 3
    assert rows(evidence.unknown_mappings(usages.withColumn("reference", F.coalesce("package", F.lit("?")))), "n_unknown", "examples") == [(2, ["?", "c"])]


@pytest.mark.parametrize("use,kind,scope,dkind,want", [("runtime", "regular", "development", "direct", False), ("runtime", "regular", "peer", "direct", True), ("runtime", "optional", "development", "direct", True), ("test", "regular", "development", "direct", True), ("build", "regular", "test", "direct", False), ("x", "regular", "build", "direct", False), ("runtime", "regular", "build", "conditional", True)])
def test_scope_acceptance(spark, use, kind, scope, dkind, want):
    assert spark.range(1).select(evidence.accepts(F.lit(use), F.lit(kind), F.lit(scope), F.lit(dkind)).alias("x")).first().x is want


def test_pages(spark):
    df = spark.range(10)
    got = inventory.page(df, ["id"], 4, 8)
    assert rows(got, "id", "truncated") == [(8, False), (9, False)] and inventory.page(df, ["id"], 4, 4).first().truncated
    with pytest.raises(ValueError):
        inventory.page(df, ["id"], 0)


def test_paths_cycles_and_reach(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("b", "t")], "parent string, child string")
    targets = spark.createDataFrame([("t",)], "node string")
    assert rows(graph.reverse_paths(edges, targets, 10).where("rooted"), "path") == [(["t", "b", "a", "r"],)]
    assert rows(graph.reverse_paths(edges, targets, 1), "length") == [(0,), (1,)]
    assert rows(graph.reachable(edges, spark.createDataFrame([("r",)], "node string")), "node", "distance") == [("a", 1), ("b", 2), ("r", 0), ("t", 3)]
    groups = graph.alias_groups(spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), (None, "z")], "a string, b string"))
    assert rows(groups, "node", "root") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]


def test_longest_prefix(spark):
    owners = spark.createDataFrame([(".", 0), ("a", 1), ("a/b", 2)], "root string, n int")
    paths = spark.createDataFrame([("a/b/c.py",), ("ab/x",), ("a/x",), (None,)], "path string")
    assert rows(lookup.longest_prefix(paths, "path", owners, "root"), "path", "n") == sorted([("a/b/c.py", 2), ("ab/x", 0), ("a/x", 1), (None, None)], key=repr)


def test_typo_mechanisms(spark):
    names = spark.createDataFrame([("reqeusts",), ("requets",), ("requestss",), ("rexuests",), ("requests",), ("other",)], "name string")
    known = spark.createDataFrame([("requests",)], "near string")
    assert rows(lookup.typo_pairs(names, known), "name", "mechanism") == [("reqeusts", "transposition"), ("requestss", "insertion"), ("requets", "deletion"), ("rexuests", "substitution")]


def test_text_functions(spark):
    df = spark.createDataFrame([("https://u:p@h/x token=abc; y",)], "t string")
    assert df.select(text.redact(F.col("t")).alias("t")).first().t == "https://***@h/x token=***; y"
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.purl(F.lit("NPM"), F.lit("b c"), F.lit("1.0"), F.lit("@s"))) == "pkg:npm/%40s/b%20c@1.0"
    got = one(text.parse_purl(F.lit("pkg:npm/%40s/b@1.0?a=b#sub")))
    assert (got.type, got.namespace, got.name, got.version, got.qualifiers, got.subpath) == ("npm", "@s", "b", "1.0", "a=b", "sub")
    assert one(text.parse_purl(F.lit("npm/b"))) is None and one(text.scope_of_path(F.lit("a/tests/x.py"))) == "test"
    assert one(text.escape_terminal(F.lit("a\x1b[0m‮b\n"))) == "a?[0m?b\n"


def test_advisories(spark, tmp_path):
    def record(i, package, events, versions=None, eco="npm", **more):
        return {"id": i, "modified": "2024-01-01T00:00:00Z", "affected": [{"package": {"ecosystem": eco, "name": package}, "versions": versions, "ranges": [{"type": "SEMVER", "events": events}] if events else []}]} | more

    records = [
        record("A", "x", [{"introduced": "0"}, {"fixed": "1.5.0"}]), record("B", "x", [{"introduced": "2.0.0"}, {"last_affected": "2.1.0"}]), record("C", "x", [{"introduced": "weird"}]),
        record("D", "y", None, ["1.0"]), record("E", "x", [{"introduced": "0"}], withdrawn="2020-01-01T00:00:00Z"), record("F", "My.Pkg", [{"introduced": "0"}, {"fixed": "2.0"}], eco="PyPI"),
    ]
    adv = feeds.osv(spark, write(tmp_path, "o.json", {"records": records}))
    resolved = spark.createDataFrame([("1", "npm", "x", "1.0.0"), ("2", "npm", "x", "2.1.0"), ("3", "npm", "x", "bad"), ("4", "npm", "y", "1.0"), ("5", "npm", "z", "1.0.0"), ("6", "pypi", "my-pkg", "1.9.post1"), ("7", "npm", "y", "2.0.0")], "identity string, ecosystem string, package string, version string")
    got = advisories.match(resolved, adv)
    status = {(r.identity, r.advisory): (r.status, r.fix) for r in got.collect()}
    assert status[("1", "A")] == ("affected", "1.5.0") and status[("1", "B")] == ("not-affected", None) and status[("2", "B")] == ("affected", None)
    assert status[("1", "C")][0] == "unknown" and status[("3", "A")][0] == "unknown" and status[("4", "D")][0] == "affected" and status[("6", "F")] == ("affected", "2.0")
    assert not any(a == "E" for _, a in status)
    assert dict(rows(advisories.observe(resolved, got), "identity", "status")) == {"1": "matched", "2": "matched", "3": "unknown", "4": "matched", "5": "not-matched-in-supplied-records", "6": "matched", "7": "not-matched-in-supplied-records"}
    groups = advisories.grouped(got, spark.createDataFrame([("A", "CVE-1")], "a string, b string"))
    assert ("1", "A", ["A"], ["1.5.0"]) in rows(groups, "identity", "root", "advisories", "fixes")


def test_reports_and_policy(spark):
    findings = spark.createDataFrame([(1, "dependency.missing", "p", "npm", "a", "warning", "m", "f", 3), (2, "dependency.missing", "p", "npm", "b", "error", "m", None, None), (3, "dependency.unused", "q", "npm", "a", "info", "m", "f", None)], "finding_id int, code string, project_id string, ecosystem string, package string, severity string, message string, path string, line int")
    assert rows(reports.finding_counts(findings), "code", "n", "severity") == [("dependency.missing", 2, "error"), ("dependency.unused", 1, "info")]
    first = json.loads(reports.sarif_results(findings).first().result)
    assert first["ruleId"] == "dependency.missing" and first["locations"][0]["physicalLocation"]["region"]["startLine"] == 3
    exempt = spark.createDataFrame([(0, "dependency.", "p", None, "a", "r", "o", "2030-01-01"), (1, "dependency.missing", None, None, "a", "r", "o", "2030-01-01"), (2, "dependency.", None, None, "b", "r", "o", "2000-01-01"), (3, "x", None, None, "b", "", "o", "2030-01-01")], "ord int, risk string, project_id string, ecosystem string, package string, reason string, owner string, expires_at string")
    judged, bad = reports.evaluate_policy(findings, exempt, "2025-01-01")
    assert rows(judged, "finding_id", "exemption") == [(1, 0), (2, None), (3, None)] and rows(bad, "ord", "state") == [(2, "expired"), (3, "invalid")]
    caps = spark.createDataFrame([("p", "complete"), ("p", "incomplete"), ("q", "complete")], "project_id string, state string")
    assert rows(reports.completeness(caps, spark.createDataFrame([("q", "error")], "project_id string, severity string")), "project_id", "complete") == [("p", False), ("q", False)]
    assert rows(reports.dot_edges(spark.createDataFrame([('a"', "b")], "parent string, child string")), "line") == [('  "a\\"" -> "b";',)]
    made = reports.cyclonedx_components(spark.createDataFrame([("r", "n", "1", None)], "ref string, name string, version string, purl string"), spark.createDataFrame([("r", "c"), ("r", "b")], "parent string, child string"))
    assert json.loads(made.first().dependency) == {"ref": "r", "dependsOn": ["b", "c"]}


def parse(files):
    return files.select("path", F.explode(F.split("text", " ")).alias("word"))


def test_refresh_equals_rebuild(spark):
    schema = "path string, digest string, text string"
    before = spark.createDataFrame([("a", "1", "x y"), ("b", "1", "z"), ("c", "1", "w")], schema)
    after = spark.createDataFrame([("a", "1", "x y"), ("b", "2", "z z"), ("d", "1", "n")], schema)
    got, state = store.refresh(parse(before), before, after, parse)
    assert rows(got, "path", "word") == rows(parse(after), "path", "word") and rows(state, "path", "digest") == rows(after, "path", "digest")
    assert rows(store.staleness(before, after), "status", "n") == [("added", 1), ("modified", 1), ("removed", 1)]


def test_publish_refuses_a_stale_base(spark, tmp_path):
    root = str(tmp_path)
    assert store.current(spark, root) is None
    one = store.publish(spark, root, {"r": spark.range(1)}, None)
    two = store.publish(spark, root, {"r": spark.range(2)}, one)
    with pytest.raises(RuntimeError):
        store.publish(spark, root, {"r": spark.range(3)}, one)
    assert store.current(spark, root) == two and store.load(spark, root, "r").count() == 2 and store.load(spark, root, "r", one).count() == 1


def test_publish_is_exclusive_and_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    one = store.publish(spark, root, {"r": spark.range(1)}, None)
    seen = store._generations(spark, root)
    store.publish(spark, root, {"r": spark.range(2)}, one)
    monkeypatch.setattr(store, "_generations", lambda *_: seen)  # a writer that looked before the other one published
    with pytest.raises(RuntimeError):
        store.publish(spark, root, {"r": spark.range(3)}, one)
    monkeypatch.undo()
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 3 and store.load(spark, root, "r").count() == 2


def test_refresh_stream(spark, tmp_path):
    schema = "path string, sequence long, digest string, text string"
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("a", 1, "9", "x y"), ("b", 1, "1", "z"), ("c", 1, "1", "w")], [("a", 3, "2", "q"), ("a", 2, "8", "old"), ("b", 2, None, None), ("c", 2, "3", "back"), ("c", 3, None, None)]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        refresh.refresh_stream(spark, spark.readStream.schema(schema).parquet(src), root, parse, "words", str(tmp_path / "ck")).awaitTermination()
    assert rows(store.load(spark, root, "words"), "path", "word") == [("a", "q")]


def test_event_windows(spark):
    events = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'view' event_type, 1.5D value union all select timestamp'2024-01-01 00:50:00', 'view', 2D")
    assert [(r.n, r.value) for r in refresh.event_counts(events).collect()] == [(2, 3.5)]
