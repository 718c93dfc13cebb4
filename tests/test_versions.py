import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from packaging.version import Version
from pyspark.sql import functions as F

from lodestrata.functions import versions as v

ORDERED = {
    "semver": ["0.0.1", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.9", "1.0.10", "2.0.0", "10.0.0"],
    "go": ["v0.9.0", "v1.0.0-rc1", "v1.0.0", "v1.2.3", "v1.10.0"],
    "rubygems": ["0.9", "1.0.a", "1.0.b2", "1.0.b10", "1.0", "1.0.1", "1.1.pre", "1.1", "1.10"],
    "pep440": ["1.0.dev1", "1.0a1.dev2", "1.0a1", "1.0a1.post1", "1.0b2", "1.0rc1", "1.0", "1.0+abc", "1.0+1", "1.0.post1.dev1", "1.0.post1", "1.0.1", "1.1", "1.10", "1!0.1"],
}


@pytest.mark.parametrize("scheme", ORDERED)
def test_keys_order_versions(spark, scheme):
    shuffled = random.Random(1).sample(list(enumerate(ORDERED[scheme])), len(ORDERED[scheme]))
    rows = spark.createDataFrame(shuffled, "i int, x string").select("i", v.version_key(F.lit(scheme), F.col("x")).alias("k")).orderBy("k").collect()
    assert [r.i for r in rows] == list(range(len(rows))) and all(r.k for r in rows)


def test_keys_of_what_is_no_version_are_null(spark):
    rows = [("semver", "1.0"), ("semver", "01.0.0"), ("semver", "1.0.0\n"), ("pep440", "x"), ("go", "1"), ("rubygems", "a"), ("maven", "1"), ("semver", None), (None, "1.0.0")]
    got = spark.createDataFrame(rows, "s string, x string").select(v.version_key(F.col("s"), F.col("x")).alias("k")).collect()
    assert all(r.k is None for r in got)


def test_equal_versions_have_equal_keys(spark):
    pairs = [("pep440", "1.0", "1.0.0"), ("pep440", "1.0-1", "1.0.post1"), ("pep440", "V1.0ALPHA1", "1.0a1"), ("semver", "1.0.0+a", "1.0.0+b"), ("rubygems", "1.0", "1"), ("rubygems", "1-a", "1.pre.a")]
    df = spark.createDataFrame(pairs, "s string, a string, b string").select((v.version_key(F.col("s"), F.col("a")) == v.version_key(F.col("s"), F.col("b"))).alias("same"))
    assert all(r.same for r in df.collect())


def test_pep440_keys_agree_with_packaging(spark):
    rng = random.Random(3)
    texts = sorted({f"{rng.choice(['', '1!'])}{rng.randrange(3)}.{rng.randrange(12)}{rng.choice(['', '.0', '.1'])}{rng.choice(['', 'a1', 'b2', 'rc10', 'rc9'])}{rng.choice(['', '.post1', '.post0'])}{rng.choice(['', '.dev3'])}{rng.choice(['', '+x.1', '+2'])}" for _ in range(300)})
    keys = {r.x: r.k for r in spark.createDataFrame([(t,) for t in texts], "x string").select("x", v.pep440_key(F.col("x")).alias("k")).collect()}
    for a, b in zip(texts, rng.sample(texts, len(texts)), strict=True):
        assert (Version(a) < Version(b), Version(a) == Version(b)) == (keys[a] < keys[b], keys[a] == keys[b]), (a, b)


@pytest.mark.parametrize("low,high", [("1", "2"), ("1-alpha-1", "1-beta-1"), ("1-beta", "1-milestone"), ("1-rc", "1-snapshot"), ("1-snapshot", "1"), ("1", "1-sp"), ("1-sp", "1.1"), ("1.0.9", "1.0.10"), ("1-alpha", "1"), ("2.0-rc1", "2.0"), ("1.foo", "1.1")])
def test_maven_order(low, high):
    assert v.maven_order(low, high) == -1 and v.maven_order(high, low) == 1


@pytest.mark.parametrize("a,b", [("1", "1.0"), ("1", "1.0.0"), ("1-ga", "1"), ("1.0.final", "1"), ("1-rc", "1-cr"), ("1a1", "1-alpha-1"), ("1.0-0", "1")])
def test_maven_equal(a, b):
    assert v.maven_order(a, b) == 0 and v.maven_order(b, a) == 0


def test_maven_compare_column_and_null(spark):
    got = spark.createDataFrame([("1", "2"), (None, "1"), (" ", "1")], "a string, b string").select(v.maven_compare(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in got] == [-1, None, None]


RANGES = {
    "^1.2.3": ("1.2.3", True, "2.0.0", False), "^0.2.3": ("0.2.3", True, "0.3.0", False), "^0.0.3": ("0.0.3", True, "0.0.4", False), "^0.0": ("0.0.0", True, "0.1.0", False), "~1.2": ("1.2.0", True, "1.3.0", False),
    "~1": ("1.0.0", True, "2.0.0", False), "1.x": ("1.0.0", True, "2.0.0", False), "*": (None, False, None, False), "1.2.3 - 2.3": ("1.2.3", True, "2.4.0", False), ">=1.0.0 <2.0.0": ("1.0.0", True, "2.0.0", False),
    ">1.2": ("1.3.0", True, None, False), "<=2": (None, False, "3.0.0", False), "1.2.3": ("1.2.3", True, "1.2.3", True), "": (None, False, None, False),
}


@pytest.mark.parametrize("text", RANGES)
def test_npm_ranges(text):
    assert v.npm_intervals(text) == [dict(zip(("lo", "lo_inclusive", "hi", "hi_inclusive"), RANGES[text], strict=True))]


def test_npm_ranges_that_are_unknown():
    assert v.npm_intervals("latest") is None and v.npm_intervals("^1.0.0-beta") is None and v.npm_intervals(None) is None
    assert len(v.npm_intervals("^1 || ^2")) == 2


def test_interval_intersection(spark):
    rows = [("^1.2.0", "~1.2.5", 1), ("^1.0.0", "^2.0.0", 0), ("<=1.0.0", ">=1.0.0", 1), ("<1.0.0", ">=1.0.0", 0), ("^1 || ^3", "^2 || ^3.1", 1), ("*", "^5", 1)]
    df = spark.createDataFrame(rows, "a string, b string, n int").select(v.npm_ranges(F.col("a")).alias("a"), v.npm_ranges(F.col("b")).alias("b"), "n")
    both = v.intersect(v.keyed_intervals(F.col("a")), v.keyed_intervals(F.col("b")))
    assert all(r.n == r.m for r in df.select("n", F.size(both).alias("m")).collect())


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 10), st.booleans()), min_size=1, max_size=20))
def test_event_fold_is_an_interval(spark, cases):
    rows = [(i, lo, lo + width, kind) for i, (lo, width, kind) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, lo int, hi int, inc boolean").crossJoin(spark.range(32).selectExpr("cast(id as int) as at"))
    events = F.array(F.struct(F.col("hi").alias("boundary"), F.when(F.col("inc"), "last_affected").otherwise("fixed").alias("kind")), F.struct(F.col("lo").alias("boundary"), F.lit("introduced").alias("kind")))
    want = (F.col("at") >= F.col("lo")) & ((F.col("at") < F.col("hi")) | (F.col("inc") & (F.col("at") == F.col("hi"))))
    assert df.where(v.event_state(events, F.col("at")) != want).count() == 0


def test_event_fold_at_open_start(spark):
    df = spark.sql("select array(named_struct('boundary', cast(null as int), 'kind', 'introduced'), named_struct('boundary', 5, 'kind', 'fixed'), named_struct('boundary', 8, 'kind', 'introduced')) e, explode(array(0, 4, 5, 8, 9)) x")
    assert [r.s for r in df.select(v.event_state(F.col("e"), F.col("x")).alias("s")).collect()] == [True, True, False, True, True]


def test_other_range_forms(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    row = lambda r: (r.lo, r.lo_inclusive, r.hi, r.hi_inclusive)
    assert row(one(v.maven_range(F.lit("[1.0,2)")))) == ("1.0", True, "2", False) and row(one(v.maven_range(F.lit("(,2]")))) == (None, False, "2", True)
    assert row(one(v.maven_range(F.lit("[1.5]")))) == ("1.5", True, "1.5", True) and one(v.maven_range(F.lit("1.0"))) is None and one(v.maven_range(F.lit("[1,2),[3,4)"))) is None
    df = spark.createDataFrame([("1.2",), ("=1.2.3",), (">=1, <1.5",), ("~1.2",)], "t string").select(v.cargo_ranges(F.col("t")).alias("r"))
    assert [row(r.r[0]) for r in df.collect()] == [("1.2.0", True, "2.0.0", False), ("1.2.3", True, "1.2.3", True), ("1.0.0", True, "1.5.0", False), ("1.2.0", True, "1.3.0", False)]
    for text, want in {"^1.2.3": ">=1.2.3,<2", "^0.2": ">=0.2,<0.3", "^0.0.3": ">=0.0.3,<0.0.4", "^0": ">=0,<1", "~1.2": ">=1.2,<1.3", "~1": ">=1,<2", ">=1": ">=1", "^1a": "^1a"}.items():
        assert one(v.poetry_specifier(F.lit(text))) == want
