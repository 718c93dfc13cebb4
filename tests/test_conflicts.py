import itertools
import random

from packaging.specifiers import SpecifierSet
from packaging.version import Version
from pyspark.sql import functions as F

from lodestrata.operators import constraints

SCHEMA = "package string, scheme string, constraint_raw string, marker string"


def run(spark, rows):
    got = constraints.conflicts(spark.createDataFrame(rows, SCHEMA), ["package"]).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r.package: r.conflict for r in got}


def test_three_values(spark):
    py, npm, mvn = "pep440", "semver", "maven"
    cases = {
        "one": ([(py, "nonsense")], False), "twice": ([(py, ">=1"), (py, ">=1")], False), "apart": ([(py, ">=2"), (py, "<2")], True), "touch": ([(py, ">=2"), (py, "<=2")], False), "open": ([(py, ">2"), (py, "<=2")], True),
        "pins": ([(py, "==1.0"), (py, "==1.1")], True), "same pin": ([(py, "==1.0"), (py, "==1.0.0")], False), "pin out": ([(py, "==1.0"), (py, "!=1.*")], True), "wild": ([(py, "==1.*"), (py, "~=1.4"), (py, "<1.5")], False), "holes": ([(py, ">=1,<=1"), (py, "!=1.0")], True),
        "unknown": ([(py, ">=1"), (py, "===x")], None), "mixed": ([(py, ">=1"), (npm, "^1.0.0")], None), "mixed pins": ([(py, "==1.0"), (npm, "1.0.0")], True), "alternatives": ([(npm, "^1 || ^3"), (npm, ">=2 <3 || >=4")], True), "meet": ([(npm, "^1 || ^3 || ^3.1"), (npm, ">=2 <3.2 || >=4"), (npm, "3.x")], False),
        "empty side": ([(npm, ">2 <1"), (npm, "*")], True), "maven": ([(mvn, "[1,2)"), (mvn, "[2,3)")], True), "maven ok": ([(mvn, "[1,2]"), (mvn, "[2,3)"), (mvn, "(,1),[2]")], False), "maven odd": ([(mvn, "[1,2)"), (mvn, "[x,3)")], None), "go": ([("go", "v1.2.3"), ("go", "v1.2.3")], False), "go apart": ([("go", "v1.2.3"), ("go", "v1.2.4")], True),
        "vcpkg": ([("vcpkg", "1.0"), ("vcpkg", "1.0")], None), "any": ([(py, ""), (py, "")], False), "null": ([(py, None), (py, ">=1")], None), None: ([(py, ">=2"), (py, "<2")], True), "early": ([(py, "==3.*"), (py, "<3.0")], True),
    }
    rows = [(k, s, t, None) for k, (texts, _) in cases.items() for s, t in texts]
    rows += [("marked", py, ">=2", "a"), ("marked", py, "<2", "b"), ("marked ok", py, ">=2", "a"), ("marked ok", py, ">=1", "b"), ("marked pins", py, "==2", "a"), ("marked pins", py, "==1", None)]
    want = {k: w for k, (_, w) in cases.items()} | {"marked": None, "marked ok": False, "marked pins": None}
    got = run(spark, rows)
    assert {k: (got[k], w) for k, w in want.items() if got[k] is not w} == {}
    assert constraints.conflicts(spark.createDataFrame([], SCHEMA), ["package"]).count() == 0


def test_equals_enumeration(spark):
    r = random.Random(2)
    grid = [Version(f"{a}.{b}{c}") for a, b, c in itertools.product(range(4), range(4), ("", ".5", ".dev1", "a1", ".post1"))]
    def clause():
        v = f"{r.randint(0, 3)}.{r.randint(0, 3)}"
        return r.choice([f">={v}", f"<={v}", f">{v}", f"<{v}", f"!={v}", f"~={v}", f"=={r.randint(0, 3)}.*", f"!={r.randint(0, 3)}.*", f"=={v}"])
    groups = {f"g{i}": [",".join(clause() for _ in range(r.choice([1, 1, 2]))) for _ in range(r.randint(2, 4))] for i in range(150)}
    got = run(spark, [(k, "pep440", t, None) for k, ts in groups.items() for t in ts])
    for k, ts in groups.items():
        assert got[k] == (not any(all(SpecifierSet(t).contains(v, prereleases=True) for t in ts) for v in grid)), (k, ts)
    assert set(got.values()) == {True, False}


def test_development_groups(spark):
    rows = [("p", "PyPI", "a", "development", "lint", ">=2"), ("p", "PyPI", "a", "development", "docs", "<2"), ("p", "PyPI", "a", "runtime", None, ">=1"), ("p", "PyPI", "a", "development", None, "<1"), ("p", "PyPI", "a", "development", "docs", ">=2"), ("p", "npm", "a", "development", "x", "^1"), ("p", "npm", "a", "runtime", None, "^2")]
    df = spark.createDataFrame(rows, "project_id string, ecosystem string, package string, scope string, group_name string, constraint_raw string").withColumn("scheme", F.when(F.col("ecosystem") == "npm", "semver").otherwise("pep440")).withColumn("marker", F.lit(None).cast("string"))
    got = constraints.conflicts(constraints.with_selection(df), ["project_id", "ecosystem", "package", "selection"]).collect()
    assert {(r.ecosystem, r.selection): (r.n_declarations, r.conflict) for r in got} == {("PyPI", "lint"): (1, False), ("PyPI", "docs"): (2, True), ("PyPI", "development"): (1, False), ("PyPI", None): (1, False), ("npm", None): (2, True)}


def test_a_hot_group(spark):
    n = 3000
    rows = spark.range(n).selectExpr("'hot' as package", "'pep440' as scheme", "concat(if(id % 2 = 0, '>=', '!='), id div 2, '.', id) as constraint_raw", "cast(null as string) as marker")
    got = constraints.conflicts(rows.unionByName(spark.createDataFrame([("cold", "pep440", "<1", None), ("cold", "pep440", ">=1", None)], SCHEMA)), ["package"]).collect()
    assert {(r.package, r.n_declarations, r.conflict) for r in got} == {("hot", n, False), ("cold", 2, True)}
