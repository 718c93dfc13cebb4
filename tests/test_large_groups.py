"""Groups of any size: results by brute force, and no plan that gathers a group in a row."""

import hashlib

import pytest

from lodestrata.operators import compare, evidence
from lodestrata.plans import store, version_queries  # noqa: F401
from lodestrata.plans.driver_queries import QUERIES

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def gathers(df):
    return "collect_list" in plan(df) or "collect_set" in plan(df)


@pytest.mark.parametrize("name", ["event_state_fold", "input_changes", "state_digest"])
def test_queries_gather_no_group(spark, name):
    assert not gathers(QUERIES[name](spark, DIR))


def test_digest_of_a_hot_group_over_many_batches(spark):
    rows = [("hot", (i * 7919) % 3000, f"ä{i}" if i % 5 else None) for i in range(3000)] + [(None, 2, "b"), (None, None, "a"), ("none", 1, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.g: r.digest for r in compare.ordered_digest(spark.createDataFrame(rows, "g string, o long, t string").repartition(7), ["g"], ["o"], compare.F.col("t"), ",").collect()}
        state = {r.g: r.digest for r in compare.state_digest(spark.createDataFrame(rows, "g string, o long, t string"), ["g"], ["o"], ["o", "t"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = lambda g: sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1]))
    text = lambda x: "" if x is None else str(x)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {g: sha(",".join(t for _, _, t in order(g) if t is not None)) for g in ("hot", "none", None)}
    assert state == {g: sha("\n".join(f"{text(o)}|{text(t)}" for _, o, t in order(g))) for g in ("hot", "none", None)}


def test_first_values_of_a_large_group(spark):
    old = spark.createDataFrame([("kept", "1")], "path string, digest string")
    new = spark.createDataFrame([("kept", "1"), *[(f"p{i:04}", "1") for i in range(500)]], "path string, digest string")
    stale = store.staleness(old, new)
    assert [(r.status, r.n, r.first_paths) for r in stale.collect()] == [("added", 500, [f"p{i:04}" for i in range(20)])]
    usages = spark.createDataFrame([("a", f"r{i % 400:03}", None) for i in range(800)] + [(None, "x", "unknown"), ("b", None, "unknown"), ("c", "y", "exact")], "project_id string, reference string, mapping_confidence string")
    unknown = evidence.unknown_mappings(usages)
    assert {(r.project_id, r.n_unknown, tuple(r.examples)) for r in unknown.collect()} == {("a", 800, ("r000", "r001", "r002")), (None, 1, ("x",)), ("b", 1, ())}
    assert "WindowGroupLimit" in plan(stale) and "WindowGroupLimit" in plan(unknown)
