"""Constraint conflicts in three values, priority lookups, markers, and update previews."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lodestrata.functions.specifiers import compiled
from lodestrata.functions.versions import intersect, keyed_intervals, npm_ranges
from lodestrata.lineage import cut

from .evidence import KEY
from .ranking import running_sum


def exact_pin(scheme: Column, raw: Column) -> Column:
    """Whether a constraint names one version."""
    return (
        F.when(scheme == "pep440", raw.rlike(r"^\s*===?\s*[^*,\s]+\s*\z")).when(scheme == "semver", raw.rlike(r"^\s*=?\s*v?\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.+-]+)?\s*\z"))
        .when(scheme == "maven", raw.rlike(r"^\s*\[[^,\[\]()]+\]\s*\z")).when(scheme.isin("go", "conan", "vcpkg"), raw.rlike(r"^\s*v?\d[^\s,\[\]<>=*^~]*\s*\z")).otherwise(F.lit(False))
    )


def semver_conflicts(declarations: DataFrame) -> DataFrame:
    """``(key, n_declarations, conflict)`` of npm constraints by key: true if no version satisfies all, null if one is unknown.

    Distinct constraints of a key meet pairwise: intervals on a line have a common point iff every two of
    single intervals do, and alternatives are intersected in turn. Constraints of a key are few and distinct.
    """
    distinct = declarations.select(*KEY, "constraint_raw").distinct().withColumn("r", npm_ranges(F.col("constraint_raw")))
    keyed = distinct.select(*KEY, F.transform("r", lambda x: x).alias("r")).withColumn("r", keyed_intervals(F.col("r")))
    counts = declarations.groupBy(KEY).agg(F.count("*").alias("n_declarations"))
    sets = keyed.groupBy(KEY).agg(F.collect_list("r").alias("known"), F.count("*").alias("n"), F.count("r").alias("n_known"))
    first = F.element_at("known", 1)
    met = F.aggregate(F.slice("known", F.lit(2), F.greatest(F.size("known"), F.lit(1))), first, lambda a, b: intersect(a, b))
    conflict = F.when(F.col("n") < 2, F.lit(False)).when(F.col("n_known") < F.col("n"), F.lit(None).cast(BooleanType())).otherwise(F.size(met) == 0)
    return counts.join(sets.where("n_known > 0").select(*KEY, conflict.alias("conflict")), KEY, "left").select(*KEY, "n_declarations", "conflict")


def with_selection(declarations: DataFrame) -> DataFrame:
    """``declarations`` with ``selection``: of a PyPI key with development declarations these are selected by ``group_name`` (else scope), all others together (null)."""
    developing = declarations.where((F.lower("ecosystem") == "pypi") & (F.col("scope") == "development")).select(KEY).distinct().withColumn("developing", F.lit(True))
    own = F.when(F.col("developing") & (F.col("scope") == "development"), F.coalesce("group_name", "scope"))
    return declarations.join(developing, KEY, "left").select(*[F.col(c) for c in declarations.columns], own.alias("selection"))


def _changes(clauses: DataFrame, by: list[str]) -> DataFrame:
    """Where each clause of ``clauses(*by, intervals)`` starts and stops to hold: ``(*by, at, side, step)`` along version keys.

    ``side`` parts places that share a key: -1 before all versions, 0 at the version, 1 right behind it. Intervals of a clause
    may overlap: only where their running number leaves or reaches zero does the clause change.
    """
    r = clauses.select(*by, F.explode("intervals").alias("r"))
    starts = r.select(*by, F.coalesce("r.lo", F.lit("")).alias("at"), F.when(F.col("r.lo").isNull(), -1).when(F.col("r.lo_inclusive"), 0).otherwise(1).alias("side"), F.lit(1).alias("step"))
    ends = r.where("r.hi is not null").select(*by, F.col("r.hi").alias("at"), F.when(F.col("r.hi_inclusive"), 1).otherwise(0).alias("side"), F.lit(-1).alias("step"))
    steps = starts.union(ends).groupBy(*by, "at", "side").agg(F.sum("step").alias("step"))
    w = W.partitionBy(*by).orderBy("at", "side")  # a clause's own places: as many as its text has bounds
    depth = steps.withColumn("now", F.sum("step").over(w)).withColumn("was", F.col("now") - F.col("step"))
    return depth.select(*by, "at", "side", ((F.col("now") > 0).cast("int") - (F.col("was") > 0).cast("int")).alias("step")).where("step <> 0")


def conflicts(declarations: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, n_declarations, conflict)``: whether no version satisfies all constraints of a group; null where it can't be told.

    ``declarations(*by, scheme, constraint_raw, marker)``. A sweep along the group's version keys: each clause of each distinct
    constraint adds one where it starts to hold and takes one off where it stops; the group can be satisfied iff the
    running sum reaches its number of clauses. Places of all groups are sorted and summed up together by ranges, so neither
    a group nor a constraint with many alternatives is gathered.

    One declaration never conflicts. Two exact pins of different versions do, also of different schemes; otherwise mixed
    schemes and constraints that aren't understood are unknown, as is a conflict of PEP 440 constraints under different markers.
    """
    scheme = F.lower("scheme")
    rows = declarations.select(*by, scheme.alias("scheme"), F.trim("constraint_raw").alias("raw"), "marker")
    texts = cut(compiled(rows))
    # what a text says, once for each text however many declare it
    pins = texts.where(exact_pin(F.when(F.col("scheme") == "cargo", "semver").otherwise(F.col("scheme")), F.col("raw")) & ((F.col("scheme") != "cargo") | F.col("raw").startswith("="))).where(F.size("clauses") == 1).select("scheme", "raw", F.col("clauses")[0]["intervals"][0]["lo"].alias("pin"))
    known = texts.select("scheme", "raw", F.size("clauses").alias("n_clauses"), F.col("clauses").isNull().alias("unknown")).join(pins, ["scheme", "raw"], "left")
    changes = cut(_changes(texts.select("scheme", "raw", F.posexplode("clauses").alias("i", "c")).select("scheme", "raw", "i", "c.intervals"), ["scheme", "raw", "i"]))
    groups = rows.groupBy(by).agg(F.count("*").alias("n_declarations"), F.count_distinct(F.coalesce("marker", F.lit(""))).alias("n_markers"))
    distinct = cut(rows.select(*by, "scheme", "raw").distinct())
    told = distinct.join(known, ["scheme", "raw"], "left").groupBy(by).agg(
        F.count_distinct("scheme").alias("n_schemes"), F.min("scheme").alias("one"), F.bool_or(F.coalesce("unknown", F.lit(True))).alias("unknown"), F.sum("n_clauses").alias("need"), F.count_distinct("scheme", "pin").alias("n_pins")
    )
    # a union of clauses over each other's changes: at each place of a group the sum of all steps there
    places = distinct.join(changes, ["scheme", "raw"]).groupBy(*by, "at", "side").agg(F.sum("step").alias("step"))
    most = running_sum(places, by, ["at", "side"], "step").groupBy(by).agg(F.max("running").alias("most"))
    same = [groups[c].eqNullSafe(told[c]) for c in by], [groups[c].eqNullSafe(most[c]) for c in by]
    out = groups.join(told, same[0], "left").join(most, same[1], "left")
    fits = (F.coalesce("need", F.lit(0)) == 0) | (F.coalesce("most", F.lit(0)) >= F.col("need"))
    unsure = (F.col("one") == "pep440") & (F.col("n_schemes") == 1) & (F.col("n_markers") > 1)
    null = F.lit(None).cast(BooleanType())
    conflict = (
        F.when(F.col("n_declarations") < 2, F.lit(False)).when(F.col("n_pins") > 1, F.when(unsure, null).otherwise(F.lit(True))).when((F.col("n_schemes") != 1) | F.col("unknown"), null)
        .when(fits, F.lit(False)).when(unsure, null).otherwise(F.lit(True))
    )
    return out.select(*[groups[c] for c in by], "n_declarations", conflict.alias("conflict"))


def priority_lookup(rows: DataFrame, key: str, tables: list[tuple[str, DataFrame]], fallback: Column | None = None) -> DataFrame:
    """``rows`` with ``package`` and ``mapping_confidence`` of the first of ``tables`` (name, ``(key, package)``) that knows ``key``; else ``fallback`` as inferred."""
    out, names, found = rows, [], []
    for i, (name, t) in enumerate(tables):
        own = t.groupBy(F.col(key)).agg(F.min("package").alias(f"p{i}_"))
        out = out.join(own, key, "left")
        names.append(F.when(F.col(f"p{i}_").isNotNull(), F.lit(name)))
        found.append(F.col(f"p{i}_"))
    last = fallback if fallback is not None else F.lit(None).cast("string")
    out = out.withColumn("package", F.coalesce(*found, last)).withColumn("mapping_confidence", F.coalesce(*names, F.when(last.isNotNull(), F.lit("inferred")).otherwise(F.lit("unknown"))))
    return out.drop(*[f"p{i}_" for i in range(len(tables))])


def effective_go_version(requires: DataFrame, replaces: DataFrame) -> DataFrame:
    """Go requirements with their replacement: one for the exact version goes before one for all; a local one has no version.

    ``replaces(package, old_version, new_package, new_version)``, null ``old_version``: all.
    """
    own = replaces.where("old_version is not null").select("package", F.col("old_version").alias("version"), F.struct("new_package", "new_version").alias("x"))
    wide = replaces.where("old_version is null").select("package", F.struct("new_package", "new_version").alias("y"))
    r = requires.join(own, ["package", "version"], "left").join(wide, "package", "left").withColumn("z", F.coalesce("x", "y"))
    return r.select(*requires.columns, F.coalesce("z.new_package", "package").alias("effective_package"), F.when(F.col("z").isNull(), F.col("version")).otherwise(F.col("z.new_version")).alias("effective_version"))


def markers(environment: dict[str, str]):
    """A function of a marker column: whether it holds in ``environment``; null where it can't be told."""

    def holds(marker: Column) -> Column:
        def judge(col: pa.Array) -> pa.Array:
            from packaging.markers import InvalidMarker, Marker, UndefinedComparison, UndefinedEnvironmentName

            known: dict[str, bool | None] = {}
            for m in set(col.to_pylist()):
                try:
                    known[m] = True if m is None else Marker(m).evaluate(environment)
                except (InvalidMarker, UndefinedComparison, UndefinedEnvironmentName):
                    known[m] = None
            return pa.array([known[m] for m in col.to_pylist()], pa.bool_())

        return F.arrow_udf(judge, BooleanType())(marker)

    return holds


def update_preview(lines: DataFrame, updates: DataFrame) -> DataFrame:
    """Rewritten requirement lines: ``lines(path, line, text, package, constraint_raw)`` with ``updates(package, version)``; exact pins only."""
    pinned = lines.where(exact_pin(F.lit("pep440"), F.col("constraint_raw")))
    new = F.regexp_replace("text", r"(===?)\s*[^\s;,#]+", F.concat(F.lit("$1"), F.col("version")))
    return pinned.join(updates, "package").select("path", "line", "text", new.alias("new_text")).where("text <> new_text")
