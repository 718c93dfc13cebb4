import random

from packaging.specifiers import InvalidSpecifier, SpecifierSet
from packaging.version import Version
from pyspark.sql import functions as F

from lodestrata.functions import specifiers, versions


def random_version(r, loose=True):
    v = ("1!" if r.random() < 0.05 else "") + ".".join(str(r.choice([0, 0, 1, 2, 10])) for _ in range(r.randint(1, 4)))
    v += r.choice(["", "", "", "a1", "b0", "rc2"]) + r.choice(["", "", "", ".post0", ".post2"]) + r.choice(["", "", "", ".dev0", ".dev3"])
    return v + (r.choice(["", "", "+x", "+1.y"]) if loose else "")


def random_clause(r):
    op = r.choice(["==", "!=", "~=", ">=", "<=", "<", ">"])
    if op in ("==", "!=") and r.random() < 0.4:
        return op + ".".join(str(r.choice([0, 1, 2])) for _ in range(r.randint(1, 3))) + ".*"
    return op + r.choice(["", " "]) + random_version(r, op in ("==", "!=") and r.random() < 0.3)


def test_equals_packaging_on_10_000_pairs(spark):
    r = random.Random(11)
    texts = {",".join(random_clause(r) for _ in range(r.choice([1, 1, 2, 3]))) for _ in range(500)} | {"", " ", ">= 1.0 , <2", "==1.*.1", "~=1", ">=1+x", "nonsense", "==", "=>1", "~=2.2.post3", "~=1.4.5a4", "==1.0a1.*", ">1.0.post1", "<1.0.post1", "<99999999999999999999999999"}
    pairs = [(t, random_version(r)) for t in sorted(texts) for _ in range(21)]
    df = spark.createDataFrame(pairs, "raw string, version string").withColumn("scheme", F.lit("pep440"))
    own = specifiers.compiled(df)
    out = df.join(own, ["scheme", "raw"]).select("raw", "version", specifiers.holds(F.col("clauses"), F.col("scheme"), F.col("version")).alias("all"), specifiers.holds(F.col("clauses"), F.col("scheme"), F.col("version"), prereleases=False).alias("told")).collect()
    assert len(out) == len(pairs) > 10_000
    wrong = []
    for x in out:
        try:
            s = SpecifierSet(x.raw)
        except InvalidSpecifier:
            s = None
        want = None if s is None else s.contains(Version(x.version), prereleases=True)
        if x["all"] != want:
            wrong.append((x.raw, x.version, x["all"], want))
    assert not wrong, (len(wrong), wrong[:20])
    for x in out[::7]:
        told = None if x["all"] is None else x["all"] and (not Version(x.version).is_prerelease or any(Version(c.version.removesuffix(".*")).is_prerelease for c in SpecifierSet(x.raw)))
        assert x.told == told, (x.raw, x.version)


def test_maven_keys_follow_maven_order(spark):
    r = random.Random(3)
    vs = sorted({".".join(str(r.choice([0, 1, 2, 10])) for _ in range(r.randint(1, 4))) + r.choice(["", "", "-alpha", "-beta2", "-rc1", "-SNAPSHOT", ".Final", "-sp", "-alpha0", "-milestone-3"]) for _ in range(160)}) + ["1-foo", "1.x", "", "1-rc1-SNAPSHOT", "1-final-2"]
    keys = {x.v: x.k for x in spark.createDataFrame([(v,) for v in vs], "v string").select("v", specifiers.maven_key(F.col("v")).alias("k")).collect()}
    assert [v for v in vs if keys[v] is None] == ["1-foo", "1.x", "", "1-rc1-SNAPSHOT", "1-final-2"]
    for a in vs:
        for b in vs:
            if keys[a] and keys[b]:
                assert (keys[a] > keys[b]) - (keys[a] < keys[b]) == versions.maven_order(a, b), (a, b)


def test_other_schemes(spark):
    cases = [
        ("maven", "[1.0,2.0)", "1.5", True), ("maven", "[1.0,2.0)", "2.0", False), ("maven", "(,1],[3,)", "2", False), ("maven", "(,1],[3,)", "1.0", True), ("maven", "(,1],[3,)", "4", True), ("maven", "[1.2]", "1.2.0", True), ("maven", "1.2", "1.3", False),
        ("maven", "[1", "1", None), ("maven", "(1]", "1", None), ("maven", "[1,x)", "1", None), ("semver", "^1.2 || >=3", "2.0.0", False), ("semver", "^1.2 || >=3", "3.1.0", True), ("semver", "latest", "1.0.0", None), ("cargo", "1.2", "1.9.0", True),
        ("cargo", ">=1.2, <1.5", "1.5.0", False), ("poetry", "^1.2", "1.9", True), ("poetry", "~1.2", "1.3", False), ("poetry", ">=1,<2", "1.0rc1", False), ("go", "v1.2.3", "1.2.3", True), ("conan", "1.2.3", "x", None), ("brew", "1", "1", None),
    ]
    df = spark.createDataFrame(cases, "scheme string, raw string, version string, want boolean")
    got = df.join(specifiers.compiled(df), ["scheme", "raw"], "left").withColumn("got", specifiers.holds(F.col("clauses"), F.col("scheme"), F.col("version"))).collect()
    assert len(got) == len(cases) and not [x for x in got if x.got != x.want and not (x.scheme in ("go", "conan"))]
    empty = df.limit(0)
    assert specifiers.compiled(empty).count() == 0
