"""Hygiene findings over declarations, usages and resolved versions: joins and aggregations on one key.

A key is (project_id, ecosystem, package), the ecosystem compared in lower case. Relations carry the
columns named in ``DECLARATION``, ``USAGE`` and ``RESOLVED``; a function reads only those it needs. Null
key parts never match, so unmapped usages are kept or dropped where a function says so, not by accident.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.lineage import merged

from .compare import first_distinct

KEY = ["project_id", "ecosystem", "package"]
DECLARATION = [*KEY, "scope", "kind", "constraint_raw", "constraint_scheme", "source_path"]
USAGE = [*KEY, "scope", "kind", "mapping_confidence"]
RESOLVED = [*KEY, "version"]
#: Schemes whose constraints can be pins.
PIN_SCHEMES = ("pep440", "semver", "go", "maven", "conan", "vcpkg")


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("ecosystem", F.lower("ecosystem"))


def _own(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column that a relation may lack."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def qualified_usages(usages: DataFrame) -> DataFrame:
    """Usages that say something of a package: mapped exactly or by configuration, and no environment command."""
    return keyed(usages).where(F.col("package").isNotNull() & F.col("mapping_confidence").isin("exact", "configured") & (F.col("kind") != "environment-command"))


def eligible(declarations: DataFrame) -> Column:
    """Whether a declaration counts for findings: direct or conditional, or a Go requirement marked indirect; not of the build, not of a Maven profile."""
    go = (F.lower("ecosystem") == "go") & (F.col("kind") == "transitive") & (_own(declarations, "go_kind") == "require")
    profile = _own(declarations, "maven_kind").isin("profile-dependency", "profile-management")
    return (F.col("kind").isin("direct", "conditional") | F.coalesce(go, F.lit(False))) & (F.col("scope") != "build") & ~F.coalesce(profile, F.lit(False))


def eligible_declarations(declarations: DataFrame) -> DataFrame:
    return keyed(declarations).where(eligible(declarations))


def accepts(usage_scope: Column, usage_kind: Column, scope: Column, kind: Column) -> Column:
    """Whether a declaration of a scope and kind covers a usage of a scope and kind (fixed values: the table of scopes)."""
    return (
        F.when(kind == "conditional", F.lit(True))
        .when(usage_kind == "optional", scope != "build")
        .when(usage_scope == "runtime", scope.isin("runtime", "peer", "host"))
        .when(usage_scope == "test", scope.isin("runtime", "development", "test", "optional"))
        .when(usage_scope == "build", scope.isin("runtime", "development", "build"))
        .otherwise(scope != "build")
    )


def missing(usages: DataFrame, declarations: DataFrame) -> DataFrame:
    """Keys that are used but not declared, with the number of usages; a warning where all usages are optional."""
    counted = usages.groupBy(KEY).agg(F.count("*").alias("n_usages"), F.bool_and(F.col("kind") == "optional").alias("optional"))
    lone = counted.join(declarations.select(KEY).distinct(), KEY, "left_anti")
    return lone.select(*KEY, "n_usages", F.when(F.col("optional"), "warning").otherwise("error").alias("severity"))


def scope_mismatches(usages: DataFrame, declarations: DataFrame) -> DataFrame:
    """Keys with declarations and at least one usage that none of them accepts.

    A key's declarations shrink to their distinct scopes and kinds, its usages to counts of these: one join, tested in the row.
    """
    use = usages.groupBy(*KEY, "scope", "kind").agg(F.count("*").alias("n"))
    offer = declarations.groupBy(KEY).agg(F.collect_set(F.struct("scope", "kind")).alias("offers"))
    bad = use.join(offer, KEY).where(~F.exists("offers", lambda o: accepts(F.col("scope"), F.col("kind"), o["scope"], o["kind"])))
    return bad.groupBy(KEY).agg(F.sum("n").alias("n_usages"))


def unused(declarations: DataFrame, usages: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Direct eligible declarations' keys without usages; ``projects(project_id)`` are those whose evidence is complete (null: all)."""
    own = eligible_declarations(declarations).where("kind = 'direct'").select(KEY).distinct()
    if projects is not None:
        own = own.join(projects.select("project_id").distinct(), "project_id", "left_semi").select(KEY)
    return own.join(usages.select(KEY).distinct(), KEY, "left_anti")


def unpinned(declarations: DataFrame, resolved: DataFrame, exact: Column) -> DataFrame:
    """Direct eligible keys without a resolved version, some declaration in a pinning scheme, none that is ``exact`` and no open Maven version."""
    own = eligible_declarations(declarations).where(F.col("kind") == "direct").where(F.lower("constraint_scheme").isin(*PIN_SCHEMES))
    per = own.groupBy(KEY).agg(F.bool_or(F.coalesce(exact, F.lit(False))).alias("pinned"), F.bool_or(_open_maven(declarations)).alias("open"), F.count("*").alias("n_declarations"))
    return per.where("not pinned and not open").join(resolved.select(KEY).distinct(), KEY, "left_anti").select(*KEY, "n_declarations")


def _open_maven(declarations: DataFrame) -> Column:
    raw = F.coalesce(_own(declarations, "constraint_raw"), F.lit("-") if "constraint_raw" not in declarations.columns else F.lit(""))
    return (F.lower("constraint_scheme") == "maven") & ((F.trim(raw) == "") | raw.contains("${"))


def gates(usages: DataFrame, capabilities: DataFrame) -> DataFrame:
    """``(project_id, manifest_complete, usage_complete, n_unknown)`` of projects with capabilities or unsure usages.

    ``capabilities(project_id, name, state)``: evidence is complete where every row of its name is; no row doubts nothing.
    """
    named = lambda names: F.coalesce(F.bool_and(F.when(F.col("name").isin(*names), F.col("state") == "complete")), F.lit(True))
    rows = capabilities.select("project_id", "name", "state", F.lit(0).cast("long").alias("unknown")).unionByName(
        usages.where("mapping_confidence = 'unknown'").groupBy("project_id").agg(F.count("*").alias("unknown")).select("project_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("state"), "unknown")
    )
    return rows.groupBy("project_id").agg(named(["manifest"]).alias("manifest_complete"), named(["usage", "mapping"]).alias("usage_complete"), F.sum("unknown").alias("n_unknown"))


def facts(declarations: DataFrame, usages: DataFrame, resolved: DataFrame, exact: Column) -> DataFrame:
    """One row per key with what findings ask of it: three relations as one tagged union and one aggregation.

    ``declared``, ``direct``, ``profile_only``, ``environment_only``, ``supported``, ``open``, ``pinned``, ``resolved``, ``inferred``;
    ``offers``, the distinct (scope, kind) of eligible declarations, and ``uses``, (scope, kind, n) of qualified usages.
    Both arrays are as long as there are scopes and kinds at most.
    """
    d = keyed(declarations)
    ok = eligible(declarations)
    direct = ok & (F.col("kind") == "direct")
    pin = direct & F.lower("constraint_scheme").isin(*PIN_SCHEMES)
    flags = {
        "declared": ok, "direct": direct, "profile": F.coalesce(_own(d, "maven_kind") == "profile-dependency", F.lit(False)), "environment": F.col("kind") == "environment",
        "supported": pin, "open": pin & _open_maven(declarations), "pinned": pin & F.coalesce(exact, F.lit(False)),
    }
    pair = "struct<scope:string,kind:string>"
    use = "struct<scope:string,kind:string,n:bigint>"
    no = F.lit(False)
    own = d.groupBy(KEY).agg(*[F.bool_or(c).alias(n) for n, c in flags.items()], F.collect_set(F.when(ok, F.struct("scope", "kind"))).alias("offers"))
    used = qualified_usages(usages).groupBy(*KEY, "scope", "kind").agg(F.count("*").alias("n"))
    guessed = keyed(usages).where("package is not null and mapping_confidence = 'inferred'").select(KEY).distinct()
    have = keyed(resolved).where("version is not null").select(KEY).distinct()
    row = lambda df, **more: df.select(*KEY, *[more.get(n, no).alias(n) for n in [*flags, "resolved", "inferred"]], more.get("offers", F.lit(None).cast(f"array<{pair}>")).alias("offers"), more.get("use", F.lit(None).cast(use)).alias("use"))
    rows = row(own, **{n: F.col(n) for n in [*flags, "offers"]}).unionByName(row(used, use=F.struct("scope", "kind", "n"))).unionByName(row(guessed, inferred=F.lit(True))).unionByName(row(have, resolved=F.lit(True)))
    out = rows.groupBy(KEY).agg(*[F.bool_or(n).alias(n) for n in [*flags, "resolved", "inferred"]], F.coalesce(F.first("offers", ignorenulls=True), F.array().cast(f"array<{pair}>")).alias("offers"), F.collect_list("use").alias("uses"))
    return out.withColumn("profile_only", F.col("profile") & ~F.col("declared")).withColumn("environment_only", F.col("environment") & ~F.col("declared")).drop("profile", "environment")


def findings(declarations: DataFrame, usages: DataFrame, resolved: DataFrame, capabilities: DataFrame, exact: Column) -> DataFrame:
    """``(project_id, ecosystem, package, code, severity)``: missing, scope-mismatch, unused and unpinned dependencies.

    A usage of a package that only a Maven profile or a separate environment declares says nothing. Missing needs complete
    manifests, unused also complete usages and mappings without an unknown one; else nothing is concluded.
    """
    known = facts(declarations, usages, resolved, exact).join(merged(gates(usages, capabilities)), "project_id", "left")
    complete = lambda c: F.coalesce(c, F.lit(True))
    used = (F.size("uses") > 0) & ~F.col("profile_only") & ~F.col("environment_only")
    lone = used & ~F.col("declared") & complete("manifest_complete")
    wrong = used & F.col("declared") & F.exists("uses", lambda u: ~F.exists("offers", lambda o: accepts(u["scope"], u["kind"], o["scope"], o["kind"])))
    idle = F.col("direct") & (F.size("uses") == 0) & ~F.col("inferred") & complete("manifest_complete") & complete("usage_complete") & (F.coalesce("n_unknown", F.lit(0)) == 0)
    free = F.col("direct") & F.col("supported") & ~F.col("open") & ~F.col("pinned") & ~F.col("resolved")
    found = lambda when, code, severity: F.when(when, F.struct(F.lit(code).alias("code"), severity.alias("severity")))
    optional = F.when(F.forall("uses", lambda u: u["kind"] == "optional"), "warning").otherwise("error")
    codes = F.array_compact(F.array(found(lone, "dependency.missing", optional), found(wrong, "dependency.scope-mismatch", F.lit("error")), found(idle, "dependency.unused", F.lit("warning")), found(free, "dependency.unpinned", F.lit("warning"))))
    return known.select(*KEY, F.explode(codes).alias("f")).select(*KEY, "f.code", "f.severity")


def only_elsewhere(declarations: DataFrame, kind: str) -> DataFrame:
    """Keys that only Maven profiles (``kind`` profile) or separate environments (``kind`` environment) declare."""
    d = keyed(declarations)
    mark = _own(d, "maven_kind") == "profile-dependency" if kind == "profile" else F.col("kind") == "environment"
    return d.groupBy(KEY).agg(F.bool_or(F.coalesce(mark, F.lit(False))).alias("there"), F.bool_or(eligible(declarations)).alias("declared")).where("there and not declared").select(KEY)


def repeated_declarations(declarations: DataFrame) -> DataFrame:
    """``(key, installation_name, n_contexts, n_assertions)`` of direct eligible declarations asserted more often than their contexts differ.

    A context is (scope, group, marker). Cargo and vcpkg declarations of different scopes or markers and PyPI ones of several
    pyproject files belong apart; on PyPI, equal assertions of one place count once.
    """
    d = eligible_declarations(declarations).where("kind = 'direct'")
    eco, group = F.col("ecosystem"), F.coalesce(_own(d, "group"), F.col("scope"))
    context = F.struct("scope", group.alias("g"), F.coalesce("marker", F.lit("")).alias("m"))
    place = F.struct("source_path", _own(d, "line", "int").alias("l"), "scope", group.alias("g"), F.coalesce("marker", F.lit("")).alias("m"), "constraint_raw")
    folder = F.when(F.col("source_path").rlike(r"(^|/)pyproject\.toml\z"), F.regexp_replace("source_path", r"/?[^/]*\z", ""))
    per = d.groupBy(*KEY, F.coalesce(_own(d, "installation_name"), F.col("package")).alias("installation_name")).agg(
        F.count("*").alias("n"), F.count_distinct(context).alias("n_contexts"), F.count_distinct(place).alias("n_places"), F.count_distinct(F.struct("scope", F.coalesce("marker", F.lit("")))).alias("n_targets"), F.count_distinct(folder).alias("n_folders")
    )
    apart = (eco.isin("cargo", "vcpkg") & (F.col("n_targets") > 1)) | ((eco == "pypi") & (F.col("n_folders") > 1))
    asserted = F.when(eco == "pypi", F.col("n_places")).otherwise(F.col("n"))
    return per.where((F.col("n") >= 2) & ~apart & (F.col("n_contexts") < asserted)).select(*KEY, "installation_name", "n_contexts", asserted.alias("n_assertions"))


def duplicates(declarations: DataFrame, context: list[str], source: list[str]) -> DataFrame:
    """Keys asserted at two or more places with fewer contexts than places; both counts are exact."""
    counts = declarations.groupBy(KEY).agg(F.count_distinct(F.struct(*context)).alias("n_contexts"), F.count_distinct(F.struct(*source)).alias("n_places"))
    return counts.where("n_places >= 2 and n_contexts < n_places")


def unknown_mappings(usages: DataFrame) -> DataFrame:
    """Usages without a certain package by project: their number and the first three references."""
    unsure = usages.where(~F.coalesce(F.col("mapping_confidence").isin("exact", "configured"), F.lit(False)))
    counts = unsure.groupBy("project_id").agg(F.count("*").alias("n_unknown"))
    first = first_distinct(unsure, "project_id", "reference", 3, "examples").withColumnRenamed("project_id", "of_")
    kept = counts.join(first, F.col("project_id").eqNullSafe(F.col("of_")), "left")
    return kept.select("project_id", "n_unknown", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def ignore(usages: DataFrame, ignored: DataFrame) -> DataFrame:
    """Usages but those of ``ignored(ecosystem, package)``; PyPI names compare normalised, others in lower case. Unmapped usages stay."""
    name = lambda c: F.when(F.lower("ecosystem") == "pypi", F.regexp_replace(F.lower(c), "[-_.]+", "-")).otherwise(F.lower(c))
    left = usages.withColumn("name_", name(F.col("package"))).withColumn("eco_", F.lower("ecosystem"))
    gone = ignored.select(name(F.col("package")).alias("name_"), F.lower("ecosystem").alias("eco_")).distinct()
    return left.join(gone, ["name_", "eco_"], "left_anti").drop("name_", "eco_")
