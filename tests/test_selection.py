from pyspark.sql import functions as F

from lodestrata.operators import selection

from .test_sources import rows


def test_third_party(spark):
    imports = spark.createDataFrame([("p", "os.path"), ("p", "requests.api"), ("p", "mine.x"), ("q", "mine")], "project_id string, reference string")
    assert rows(selection.third_party(imports, spark.createDataFrame([("p", "mine")], "project_id string, module string")), "project_id", "reference") == [("p", "requests.api"), ("q", "mine")]


def test_workspace_members(spark):
    folders = spark.createDataFrame([("packages/a",), ("packages/a/b",), ("packages/skip",), ("x+y/c",), ("deep/1/2",), ("sub/packages/z",)], "folder string")
    globs = spark.createDataFrame([(".", "packages/*"), (".", "!packages/skip"), (".", "./x+y/?"), (".", "deep/**"), ("sub", "packages/*/")], "workspace string, glob string")
    assert rows(selection.workspace_members(folders, globs), "workspace", "folder") == [(".", "deep/1/2"), (".", "packages/a"), (".", "x+y/c"), ("sub", "sub/packages/z")]


def test_scores(spark):
    schema = "id int, positive boolean"
    expected = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False), (5, True), (6, True)], schema)
    observed = spark.createDataFrame([(1, True), (2, False), (3, True), (4, False), (5, None), (7, True)], schema)
    assert selection.scores(expected, observed, ["id"]).first().asDict() == {"tp": 1, "fp": 2, "fn": 2, "tn": 1, "unknown": 1}


def test_membership_changes(spark):
    schema = "cve string, due string"
    old, new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], schema), spark.createDataFrame([("b", "2"), ("c", None), ("d", "1")], schema)
    assert rows(selection.membership_changes(old, new, "cve", ["due"], "2024-01-01", "2024-02-01"), "cve", "change") == [("a", "removed"), ("b", "changed"), ("c", "unchanged"), ("d", "added")]
    assert selection.membership_changes(old, new, "cve", ["due"], "2024-02-01", "2024-01-01").count() == 0


def test_nested_page(spark):
    df = spark.range(1).select(F.array(*map(F.lit, range(5))).alias("a"), F.array(F.lit(1)).alias("b"))
    got = selection.nested_page(df, ["a", "b"], 2, 2).first()
    assert (got.a, got.b, got.n_a, got.truncated) == ([2, 3], [], 5, True)


def test_importers(spark):
    m = spark.createDataFrame([(".", "a", "^1"), (".", "b", "^1"), (".", "c", "^1")], "importer string, package string, constraint_raw string")
    k = spark.createDataFrame([(".", "a", "^1"), (".", "b", "^2"), (".", "d", "^1")], "importer string, package string, specifier string")
    assert rows(selection.importer_mismatches(m, k), "package", "problem") == [("b", "specifier-differs"), ("c", "not-locked"), ("d", "not-declared")]


def test_pep440_conflicts(spark):
    cases = {"a": ["==1.0", "==2.0"], "b": [">=2", "<2"], "c": [">=2", "<=2.0"], "d": ["==1.5", ">=1,<2"], "e": ["==2.5", "<2"], "f": ["what"], "g": [""], "h": ["==1.*", ">=2"], "i": [">1", "==1.0"], "j": ["~=1.0,!=1.1"], "k": ["==1.0", "==1"]}
    df = spark.createDataFrame([("p", "pypi", k, c) for k, cs in cases.items() for c in cs], "project_id string, ecosystem string, package string, constraint_raw string")
    want = {"a": True, "b": True, "c": False, "d": False, "e": True, "f": None, "g": False, "h": False, "i": True, "j": False, "k": False}
    assert {r.package: r.conflict for r in selection.pep440_conflicts(df).collect()} == want


def test_pages_by_bytes_follow_the_halving_rule(spark):
    import random

    r = random.Random(4)
    lists = {(q, rec, c): ["x" * r.randint(0, 40) + "é" * r.randint(0, 3) for _ in range(r.choice([0, 1, 5, 40, 130]))] for q in range(12) for rec in range(3) for c in "ab"}
    rows = [(q, rec, c, i, t) for (q, rec, c), ts in lists.items() for i, t in enumerate(ts)]
    entries = spark.createDataFrame([*rows, (99, 0, "a", 0, None)], "q int, record int, list string, place int, json string")
    responses = spark.createDataFrame([(q, 50) for q in range(13)] + [(99, 10), (77, 5000)], "q int, base_bytes int")
    for limit, offset, budget in ((100, 0, 900), (7, 3, 400), (1, 0, 60)):
        pages = selection.byte_pages(responses, entries, ["q"], limit, offset, budget)
        got = {p.q: p for p in pages.collect()}
        kept = {q: sum(1 for e in selection.page_entries(entries, pages, ["q"], offset).collect() if e.q == q) for q in range(12)}
        assert got[77].status == "budget-exceeded" or budget >= 5000
        assert got[12].page_limit == limit and not got[12].truncated
        for q in range(12):
            own, k = [ts for (p, _, _), ts in lists.items() if p == q], limit
            size = lambda k: 50 + sum(len(t.encode()) + 2 for ts in own for t in ts[offset : offset + k])  # noqa: B023, E731
            while size(k) > budget and k > 1:
                k = max(1, k // 2)
            fits = size(k) <= budget
            assert (got[q].status, got[q].page_limit) == (("ok", k) if fits else ("budget-exceeded", None))
            if fits:
                more = any(len(ts) > offset + k for ts in own)
                assert (got[q].n_bytes, got[q].truncated, got[q].next_offset) == (size(k), more, offset + k if more else None) and kept[q] == sum(len(ts[offset : offset + k]) for ts in own)
