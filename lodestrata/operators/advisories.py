"""Resolved versions against advisory records: a hash join on the package with three-valued range membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import pypi_name
from lodestrata.functions.versions import event_state, maven_local_keys, valid_events, version_key

from .graph import alias_groups

#: Ecosystem -> version scheme.
SCHEMES = {"pypi": "pep440", "npm": "semver", "cargo": "semver", "crates.io": "semver", "go": "go", "rubygems": "rubygems"}


def package_name(ecosystem: Column, name: Column) -> Column:
    e = F.lower(ecosystem)
    return F.when(e == "pypi", pypi_name(name)).when(e == "npm", F.lower(name)).otherwise(name)


def scheme_of(ecosystem: Column) -> Column:
    out = F.lit(None).cast("string")
    for eco, scheme in SCHEMES.items():
        out = F.when(F.lower(ecosystem) == eco, scheme).otherwise(out)
    return out


def match(resolved: DataFrame, advisories: DataFrame, now: str | None = None) -> DataFrame:
    """A row for each resolved identity and advisory of its package: ``status`` affected, not-affected or unknown, ``fix``, ``invalid``.

    ``resolved(identity, ecosystem, package, version)``; ``advisories(advisory, ecosystem, package, versions,
    ranges, withdrawn)`` with ``ranges`` an array of arrays of (boundary, kind) in version text. Withdrawn ones
    (at or before ``now``, a timestamp text; default: the current time) are left out. An advisory lists a
    version or holds it in a range: affected. A version or boundary that doesn't parse, an ecosystem without a
    scheme and a range that ``valid_events`` refuses (``invalid`` tells) establish nothing: unknown, unless another
    range or the list says affected. ``fix`` is the first fixed boundary after the version that no range holds.

    The join is on the package. Distinct versions and each advisory's boundaries are keyed once, so ranges fold as text;
    Maven, whose order has no such key, gets keys by pair of version and advisory.
    """
    at = F.current_timestamp() if now is None else F.to_timestamp(F.lit(now))
    eco = F.col("eco")
    own = resolved.select("identity", F.lower("ecosystem").alias("eco"), package_name(F.col("ecosystem"), F.col("package")).alias("name"), "version")
    keys = own.select("eco", "version").distinct().withColumn("vk", version_key(scheme_of(eco), F.col("version")))
    own = own.join(keys, ["eco", "version"])
    live = advisories.where(F.col("withdrawn").isNull() | (F.col("withdrawn") > at))
    adv = live.select(
        "advisory", F.lower("ecosystem").alias("eco"), package_name(F.col("ecosystem"), F.col("package")).alias("name"),
        F.coalesce("versions", F.array().cast("array<string>")).alias("listed"), F.coalesce("ranges", F.array().cast("array<array<struct<boundary:string,kind:string>>>")).alias("ranges"),
    )
    # the version 0 that introduces, and the limit *, lie before and behind every version: they have no key
    open_end = lambda e: ((e["kind"] == "introduced") & (e["boundary"] == "0")) | ((e["kind"] == "limit") & (e["boundary"] == "*"))
    keyed = lambda e, key: F.struct(F.when(~open_end(e), key).alias("boundary"), e["kind"].alias("kind"), (~open_end(e) & key.isNull()).alias("bad"), e["boundary"].alias("raw"))
    by_scheme = F.transform("ranges", lambda r: F.transform(r, lambda e: keyed(e, version_key(scheme_of(eco), e["boundary"]))))
    adv = adv.withColumn("texts", F.array_distinct(F.concat("listed", F.transform(F.flatten("ranges"), lambda e: e["boundary"])))).withColumn("keyed", by_scheme)
    both = own.join(adv, ["eco", "name"]).withColumn("local", maven_local_keys(F.when(eco == "maven", F.col("version")), F.when(eco == "maven", F.col("texts"))))
    place = F.map_from_arrays("texts", "local.keys")
    both = both.withColumn("places", F.when(F.col("local").isNotNull(), place)).withColumn("vk", F.when(eco == "maven", F.col("local.own")).otherwise(F.col("vk")))
    both = both.withColumn("keyed", F.when(eco == "maven", F.transform("ranges", lambda r: F.transform(r, lambda e: keyed(e, F.try_element_at("places", e["boundary"]))))).otherwise(F.col("keyed")))
    # boundaries without a key are told apart by their text
    valid = lambda r: valid_events(F.transform(r, lambda e: F.struct(F.coalesce(e["boundary"], e["raw"]).alias("boundary"), e["kind"].alias("kind"))))
    usable = lambda r: ~F.exists(r, lambda e: e["bad"]) & valid(r)
    both = both.withColumn("good", F.filter("keyed", usable))
    key_of = lambda v: F.when(eco == "maven", F.try_element_at("places", v)).otherwise(version_key(scheme_of(eco), v))
    listed = F.array_contains("listed", F.col("version")) | F.coalesce(F.exists("listed", lambda v: key_of(v) == F.col("vk")), F.lit(False))
    hit = F.col("vk").isNotNull() & F.coalesce(F.exists("good", lambda r: event_state(r, F.col("vk"))), F.lit(False))
    unsure = (F.col("vk").isNull() & (F.size("keyed") > 0)) | (F.size("good") < F.size("keyed")) | ((F.size("keyed") == 0) & (F.size("listed") == 0))
    status = F.when(listed | hit, "affected").when(unsure, "unknown").otherwise("not-affected")
    fixes = F.filter(F.flatten("good"), lambda e: (e["kind"] == "fixed") & (e["boundary"] > F.col("vk")))
    free = F.filter(fixes, lambda f: ~F.exists("good", lambda r: event_state(r, f["boundary"])) & ~F.array_contains("listed", f["raw"]))
    best = F.array_sort(F.transform(free, lambda f: F.struct(f["boundary"], f["raw"])))
    invalid = F.exists("keyed", lambda r: ~valid(r))
    return both.select("identity", "advisory", "version", status.alias("status"), F.when(status == "affected", F.try_element_at(best, F.lit(1))["raw"]).alias("fix"), invalid.alias("invalid"))


def observe(resolved: DataFrame, matches: DataFrame) -> DataFrame:
    """``(identity, status)``: matched if any advisory affects it, unknown if any is unknown, else not-matched-in-supplied-records."""
    seen = matches.groupBy("identity").agg(F.bool_or(F.col("status") == "affected").alias("hit"), F.bool_or(F.col("status") == "unknown").alias("unsure"))
    status = F.when(F.col("hit"), "matched").when(F.col("unsure"), "unknown").otherwise("not-matched-in-supplied-records")
    return resolved.select("identity").distinct().join(seen, "identity", "left").select("identity", status.alias("status"))


def grouped(matches: DataFrame, aliases: DataFrame) -> DataFrame:
    """Affected advisories by identity and alias group: ``(identity, root, advisories, fixes)``; ``aliases(a, b)``."""
    roots = alias_groups(aliases)
    rows = matches.where("status = 'affected'").join(roots.withColumnRenamed("node", "advisory"), "advisory", "left").withColumn("root", F.coalesce("root", "advisory"))
    return rows.groupBy("identity", "root").agg(F.array_sort(F.collect_set("advisory")).alias("advisories"), F.array_sort(F.collect_set("fix")).alias("fixes"))
