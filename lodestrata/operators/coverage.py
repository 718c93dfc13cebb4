"""What a scan selected, may ask about, and didn't cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes of diagnostics that mean a gap besides those their form tells.
GAP_CODES = (
    "resolution.cargo-activation-unknown", "resolution.package-manager-ambiguous", "resolution.workspace-ambiguous", "resolution.uv-workspace-activation-unknown", "resolution.pylock-activation-unknown",
    "resolution.python-source-unverified", "resolution.cmake-activation-unknown", "resolution.bazel-module-graph-unknown", "resolution.go-build-list-unknown", "resolution.gradle-build-graph-unknown",
    "resolution.gradle-catalog-activation-unknown", "resolution.yarn-activation-unknown", "resolution.script-environment-unknown", "analysis.python-group-selection-unknown",
    "analysis.python-environment-selection-unknown", "resolution.hatch-environment-activation-unknown", "analysis.constraint-intersection-unknown", "configuration.go-tool-owner-unresolved",
    "configuration.go-tool-budget", "manifest.cmake-dynamic",
)
GAP_PREFIXES = ("command.", "usage.rust-", "manifest.gradle-catalog-", "manifest.yarn-lock-")
#: Purl prefixes that make a resolved version of an ecosystem one of the public registry.
PUBLIC_PURL = {"maven": "pkg:maven/", "pypi": "pkg:pypi/", "cargo": "pkg:cargo/", "npm": "pkg:npm/"}


def select_projects(projects: DataFrame, ids: DataFrame | None = None, ecosystems: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Projects of the enabled ecosystems (without regard to case) and requested ``ids(project_id)``, and the requested ids that no project has."""
    own = projects if ecosystems is None else projects.where(F.lower("ecosystem").isin([e.lower() for e in ecosystems]))
    if ids is None:
        return own, projects.select("project_id").limit(0)
    wanted = ids.select("project_id").distinct()
    return own.join(wanted, "project_id", "left_semi"), wanted.join(projects.select("project_id"), "project_id", "left_anti")


def advisory_eligible(resolved: DataFrame) -> DataFrame:
    """Rows of ``resolved(..., ecosystem, version, purl, public)`` that public advisories can be asked about.

    They have a version; Maven, PyPI, Cargo and npm ones the registry's package URL; Maven ones a public origin, npm ones no private one.
    """
    eco = F.lower("ecosystem")
    purl = F.lit(True)
    for name, prefix in PUBLIC_PURL.items():
        purl = F.when(eco == name, F.coalesce(F.col("purl").startswith(prefix), F.lit(False))).otherwise(purl)
    origin = F.when(eco == "maven", F.coalesce(F.col("public"), F.lit(False))).when(eco == "npm", F.coalesce(F.col("public"), F.lit(True))).otherwise(True)
    return resolved.where(F.col("version").isNotNull() & (F.col("version") != "") & purl & origin)


def foreign_headers(includes: DataFrame, files: DataFrame, standard: list[str]) -> DataFrame:
    """``includes(path, reference, quoted)`` that are neither standard headers nor, if quoted, files beside the source or under the root."""
    there = files.select(F.col("path").alias("file")).distinct()
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "/")).otherwise("")
    rows = includes.where(~F.col("reference").isin(*standard) & ~F.col("reference").startswith("sys/")).withColumn("beside", F.concat(folder, "reference"))
    own = rows.where(~F.col("quoted")).select(*includes.columns)
    quoted = rows.where("quoted").join(there.withColumnRenamed("file", "beside"), "beside", "left_anti").join(there.withColumnRenamed("file", "reference"), "reference", "left_anti")
    return own.unionByName(quoted.select(*includes.columns))


def uncovered_manifests(files: DataFrame, covered: DataFrame, names: list[str], suffixes: list[str]) -> DataFrame:
    """``(path)`` of ``files(path)`` that look like manifests (by name, or by suffix without regard to case) and that no collector of ``covered(path)`` read."""
    name = F.substring_index("path", "/", -1)
    known = name.isin(*names)
    for suffix in suffixes:
        known = known | F.lower(name).endswith(suffix)
    return files.where(known & ~name.isin("build.gradle", "build.gradle.kts")).select("path").distinct().join(covered.select("path").distinct(), "path", "left_anti")


def gaps(diagnostics: DataFrame, capabilities: DataFrame, uncovered: DataFrame) -> DataFrame:
    """Distinct ``(path, reason, project_id)`` that evidence doesn't cover.

    From ``diagnostics(project_id, code, severity, path)`` with a path whose code means a gap, ``capabilities(project_id, root, name,
    state)`` that are unsupported, and ``uncovered(path)`` manifests, which have no project.
    """
    code, name = F.col("code"), F.substring_index("path", "/", -1)
    means = code.contains("unsupported") | code.contains("uncollected") | code.isin(*GAP_CODES) | (name.rlike(r"^pylock(\.[^.]+)?\.toml\z") & (F.col("severity") == "error"))
    for prefix in GAP_PREFIXES:
        means = means | code.startswith(prefix)
    own = diagnostics.where(F.col("path").isNotNull() & means).select("path", code.alias("reason"), "project_id")
    lacking = capabilities.where("state = 'unsupported'").select(F.col("root").alias("path"), F.concat(F.lit("capability."), "name", F.lit("-unsupported")).alias("reason"), "project_id")
    manifests = uncovered.select("path", F.lit("coverage.unsupported-manifest").alias("reason"), F.lit(None).cast(dict(diagnostics.dtypes)["project_id"]).alias("project_id"))
    return own.unionByName(lacking).unionByName(manifests).distinct()
