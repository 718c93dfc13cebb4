"""Constraint texts compiled to interval sets over version order keys.

A text becomes clauses that all must hold; a clause is a union of disjoint intervals of keys. PEP 440 clauses are compiled
by built-in expressions, one row for each clause; SemVer ranges go through ``npm_ranges`` and Maven's through
``maven_key``. A text that doesn't parse has null clauses: unknown, not empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import PEP440, _num, cargo_ranges, keyed_intervals, npm_ranges, pep440_key, poetry_specifier, semver_key, version_key

INTERVALS = "array<struct<lo:string,lo_inclusive:boolean,hi:string,hi_inclusive:boolean>>"
CLAUSES = f"array<struct<intervals:{INTERVALS},pre:boolean>>"

#: Operators of PEP 440 specifiers, longest first.
_CLAUSE = r"^\s*(===|~=|==|!=|<=|>=|<|>)\s*(\S+)\s*\z"
#: Maven versions that have a key: numbers, then perhaps one known qualifier with a number.
_MAVEN = r"(?i)^\s*(\d+(?:\.\d+)*)(?:[-.]?(alpha|beta|milestone|rc|cr|snapshot|ga|final|release|sp)[-.]?(\d*))?\s*\z"
#: The key of 0.dev0, below which there is no PEP 440 version.
_FIRST = "0000.0000 0 0 00000"
#: Behind all keys that go on behind these parts, before those of the next part's value.
_END = "!"


def maven_key(version: Column) -> Column:
    """A key whose text order is Maven's order among numeric versions with at most one known qualifier; null for all others."""
    part = lambda i: F.regexp_extract(version, _MAVEN, i)
    name = F.lower(part(2))
    rank = F.when(name == "alpha", "1").when(name == "beta", "2").when(name == "milestone", "3").when(name.isin("rc", "cr"), "4").when(name == "snapshot", "5").when(name == "sp", "7").otherwise("6")
    release = F.array_join(F.transform(F.split(F.regexp_replace(part(1), r"(\.0+)+\z", ""), r"\."), _num), ".")
    plain = (rank != "6") | (part(3) == "")  # a number behind a release name starts a list of its own
    return F.when(version.rlike(_MAVEN) & plain, F.concat(release, F.lit(" "), rank, _num(part(3))))


def constraint_key(scheme: Column, version: Column) -> Column:
    """The order key of a version for its scheme's constraints."""
    return F.when(scheme == "maven", maven_key(version)).when(scheme.isin("cargo", "poetry"), F.when(scheme == "cargo", semver_key(version)).otherwise(pep440_key(version))).otherwise(version_key(scheme, version))


def _interval(lo: Column | None, lo_in: bool, hi: Column | None, hi_in: bool) -> Column:
    null = F.lit(None).cast("string")
    return F.struct((F.lit(_FIRST) if lo is None else lo).alias("lo"), F.lit(lo_in or lo is None).alias("lo_inclusive"), (null if hi is None else hi).alias("hi"), F.lit(hi_in).alias("hi_inclusive"))


def pep440_clause(op: Column, text: Column) -> Column:
    """(intervals, pre) of one clause; null where it isn't a valid one. Prereleases count as versions here (see ``holds``)."""
    v = F.lower(text)
    star = v.endswith(".*")
    plain = F.when(star, F.expr("substring(v, 1, length(v) - 2)")).otherwise(F.col("v"))
    part = lambda i: F.regexp_extract(plain, PEP440, i)
    key = pep440_key(plain)
    pre, post, dev, local = part(3) != "", (part(5) != "") | (part(6) != ""), part(8) != "", part(10) != ""
    epoch = F.concat(_num(part(1)), F.lit("."))
    numbers = F.split(part(2), r"\.")

    def release(parts: Column) -> Column:
        return F.concat(epoch, F.array_join(F.transform(F.split(F.regexp_replace(F.array_join(parts, "."), r"(\.0+)+\z", ""), r"\."), _num), "."))

    def after(parts: Column) -> Column:  # the release whose last number is one more
        n = F.size(parts)
        return release(F.concat(F.slice(parts, F.lit(1), n - 1), F.array((F.element_at(parts, -1).try_cast("decimal(38,0)") + 1).cast("string"))))

    first = lambda r: F.concat(r, F.lit(" 0 0 00000"))  # noqa: E731  its earliest development release
    own = release(numbers)
    past = F.concat(key, F.lit(_END))  # behind the version's local versions
    family = F.slice(numbers, F.lit(1), F.greatest(F.size(numbers) - 1, F.lit(1)))
    made = lambda intervals: F.struct(F.array(*intervals).cast(INTERVALS).alias("intervals"), (pre | dev).alias("pre"))
    wild, bare = star & ~(pre | post | dev | local), ~star & ~local
    equal = (
        F.when(star, F.when(wild, made([_interval(first(own), True, first(after(numbers)), False)])))
        .when(local, made([_interval(key, True, key, True)])).otherwise(made([_interval(key, True, past, False)]))
    )
    unequal = (
        F.when(star, F.when(wild, made([_interval(None, False, first(own), False), _interval(first(after(numbers)), True, None, False)])))
        .when(local, made([_interval(None, False, key, False), _interval(key, False, None, False)])).otherwise(made([_interval(None, False, key, False), _interval(past, True, None, False)]))
    )
    # below a release nor its prereleases; above one nor its post-releases; neither names a version's local ones
    floor = F.when(pre | dev, key).when(post, F.concat(F.substring_index(key, " ", 3), F.lit(" 00000"))).otherwise(first(own))
    ceiling = F.when(dev | post, past).otherwise(F.concat(F.substring_index(key, " ", 2), F.lit(_END)))
    out = (
        F.when(op == "==", equal).when(op == "!=", unequal).when((op == "~=") & bare & (F.size(numbers) > 1), made([_interval(key, True, first(after(family)), False)]))
        .when((op == ">=") & bare, made([_interval(key, True, None, False)])).when((op == "<=") & bare, made([_interval(None, False, past, False)])).when((op == "<") & bare, made([_interval(None, False, floor, False)])).when((op == ">") & bare, made([_interval(ceiling, True, None, False)]))
    )
    return F.when(key.isNotNull(), out)


def _pep440(texts: DataFrame) -> DataFrame:
    rows = texts.select("scheme", "raw", F.posexplode(F.split("t", ",")).alias("i", "c"))
    rows = rows.where(F.trim("c") != "").withColumn("op", F.regexp_extract("c", _CLAUSE, 1)).withColumn("v", F.lower(F.regexp_extract("c", _CLAUSE, 2)))
    found = rows.select("scheme", "raw", "i", pep440_clause(F.col("op"), F.col("v")).alias("x"))
    per = found.groupBy("scheme", "raw").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("xs"))
    known = F.when(F.forall("xs", lambda y: y["x"].isNotNull()), F.transform("xs", lambda y: y["x"]).cast(CLAUSES))
    return texts.join(per, ["scheme", "raw"], "left").select("scheme", "raw", F.when(F.col("n").isNull() & F.col("t").isNotNull(), F.array().cast(CLAUSES)).otherwise(known).alias("clauses"))


def _union(intervals: Column) -> Column:
    """One clause of keyed intervals; null where a bound's text has no key."""
    return F.when(intervals.isNotNull(), F.array(F.struct(intervals.cast(INTERVALS).alias("intervals"), F.lit(False).alias("pre"))).cast(CLAUSES))


def _maven(raw: Column) -> Column:
    """Bracketed ranges, one or several; a bare version is a point."""
    piece, both = r"[\[(][^\[\]()]*[\])]", r"^([\[(])\s*([^,]*?)\s*(,?)\s*([^,]*?)\s*([\])])\z"
    pieces = F.regexp_extract_all(raw, F.lit(piece), F.lit(0))
    part = lambda p, i: F.regexp_extract(p, both, i)

    def one(p: Column) -> Column:
        low, high, comma = part(p, 2), part(p, 4), part(p, 3) != ""
        only = F.when(low != "", low).otherwise(high)
        a, b = F.when(comma, low).otherwise(only), F.when(comma, high).otherwise(only)
        bad = ~p.rlike(both) | ((a != "") & maven_key(a).isNull()) | ((b != "") & maven_key(b).isNull()) | (~comma & ((part(p, 1) != "[") | (part(p, 5) != "]") | (only == "")))
        return F.when(~bad, F.struct(maven_key(a).alias("lo"), (part(p, 1) == "[").alias("lo_inclusive"), maven_key(b).alias("hi"), (part(p, 5) == "]").alias("hi_inclusive")))

    ranges = F.when(raw.rlike(rf"^\s*{piece}(\s*,\s*{piece})*\s*\z"), F.transform(pieces, one))
    point = maven_key(raw)
    whole = F.when(point.isNotNull(), F.array(F.struct(point.alias("lo"), F.lit(True).alias("lo_inclusive"), point.alias("hi"), F.lit(True).alias("hi_inclusive")))).otherwise(ranges)
    return F.when(F.forall(whole, lambda x: x.isNotNull()), whole)


def compiled(texts: DataFrame) -> DataFrame:
    """``(scheme, raw, clauses)`` of the distinct ``texts(scheme, raw)``; null clauses where the text or scheme isn't understood.

    Schemes: pep440, poetry (its carets and tildes, else pep440), semver, cargo, maven; of go, conan and vcpkg only
    plain versions. An empty PEP 440 text allows everything. ``===`` compares texts, which have no order: unknown.
    """
    rows = texts.select("scheme", "raw").where("scheme is not null and raw is not null").distinct()
    python = rows.where("scheme in ('pep440', 'poetry')").withColumn("t", F.when(F.col("scheme") == "poetry", poetry_specifier(F.col("raw"))).otherwise(F.col("raw")))
    ranges = rows.where("scheme in ('semver', 'cargo')").withColumn("r", npm_ranges(F.when(F.col("scheme") == "semver", F.col("raw"))))
    ranges = ranges.withColumn("r", F.when(F.col("scheme") == "cargo", cargo_ranges(F.col("raw"))).otherwise(F.col("r"))).select("scheme", "raw", keyed_intervals(F.col("r")).alias("r"))
    maven = rows.where("scheme = 'maven'").select("scheme", "raw", _maven(F.col("raw")).alias("r"))
    point = semver_key(F.regexp_replace(F.trim("raw"), "^v", ""))
    plain = rows.where("scheme in ('go', 'conan', 'vcpkg')").select("scheme", "raw", F.when(point.isNotNull(), F.array(F.struct(point.alias("lo"), F.lit(True).alias("lo_inclusive"), point.alias("hi"), F.lit(True).alias("hi_inclusive")))).alias("r"))
    return _pep440(python).unionByName(ranges.unionByName(maven).unionByName(plain).select("scheme", "raw", _union(F.col("r")).alias("clauses")))


def within(key: Column, r: Column) -> Column:
    """Whether a key lies in the interval ``r``."""
    low = r["lo"].isNull() | (r["lo"] < key) | (r["lo_inclusive"] & (r["lo"] == key))
    return low & (r["hi"].isNull() | (key < r["hi"]) | (r["hi_inclusive"] & (r["hi"] == key)))


def holds(clauses: Column, scheme: Column, version: Column, prereleases: bool = True) -> Column:
    """Whether ``version`` satisfies all ``clauses``; null where either isn't understood.

    Without ``prereleases``, PEP 440 prereleases only count where a clause names one.
    """
    key = constraint_key(scheme, version)
    fits = F.forall(clauses, lambda c: F.exists(c["intervals"], lambda r: within(key, r)))
    if not prereleases:
        v = F.lower(F.trim(version))
        early = scheme.isin("pep440", "poetry") & ((F.regexp_extract(v, PEP440, 3) != "") | (F.regexp_extract(v, PEP440, 8) != ""))
        fits = fits & (~early | F.exists(clauses, lambda c: c["pre"]))
    return F.when(key.isNotNull() & clauses.isNotNull(), fits)
