"""Reports of findings and inventories as JSON, and policy over findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import escape_terminal

#: Severities in ascending order and their SARIF levels.
SEVERITIES = {"info": "note", "warning": "warning", "error": "error"}


def severity_rank(column: str = "severity"):
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(column))


def finding_counts(findings: DataFrame) -> DataFrame:
    """``(code, n, severity)``: findings by code with their highest severity."""
    return findings.groupBy("code").agg(F.count("*").alias("n"), F.max_by("severity", severity_rank()).alias("severity"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """A SARIF 2.1.0 result object (JSON) for each of ``findings(code, severity, message, path, line)``; written as lines, no list is gathered."""
    level = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), F.col("severity"))
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine")))
    location = F.when(F.col("path").isNotNull(), F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))))
    return findings.select(F.to_json(F.struct(F.col("code").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), location.alias("locations"))).alias("result"))


def text_lines(findings: DataFrame) -> DataFrame:
    """A report line for each of ``findings(code, severity, package, message, path, line)``, control characters escaped; order is the reader's."""
    place = F.when(F.col("path").isNotNull(), F.concat(F.lit(" ("), "path", F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")), F.lit(")"))).otherwise("")
    return findings.select(escape_terminal(F.concat(F.upper("severity"), F.lit(" "), "code", F.lit(" "), "package", F.lit(": "), "message", place)).alias("line"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    return finding_counts(findings).select(F.to_json(F.struct(F.col("code").alias("id"), F.struct(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), F.col("severity")).alias("level")).alias("defaultConfiguration"))).alias("rule"))


def cyclonedx_components(inventory: DataFrame, edges: DataFrame) -> DataFrame:
    """A CycloneDX component (JSON) and its sorted dependencies for each of ``inventory(ref, name, version, purl)``; ``edges(parent, child)``."""
    deps = edges.groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("dependsOn"))
    component = F.to_json(F.struct(F.lit("library").alias("type"), F.col("ref").alias("bom-ref"), "name", "version", "purl"))
    dependency = F.to_json(F.struct("ref", F.coalesce("dependsOn", F.array().cast("array<string>")).alias("dependsOn")))
    return inventory.join(deps, inventory["ref"] == deps["parent"], "left").select("ref", component.alias("component"), dependency.alias("dependency"))


def dot_edges(edges: DataFrame) -> DataFrame:
    """Graphviz lines of ``edges(parent, child)``; quotes and backslashes are escaped."""
    safe = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c), r'(["\\])', r"\\$1"), F.lit('"'))
    return edges.distinct().select(F.concat(F.lit("  "), safe("parent"), F.lit(" -> "), safe("child"), F.lit(";")).alias("line"))


def evaluate_policy(findings: DataFrame, exemptions: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Findings with the exemption that consumes each (the first in order), and expired or invalid exemptions.

    ``findings(finding_id, code, project_id, ecosystem, package)``; ``exemptions(ord, risk, project_id, ecosystem,
    package, reason, owner, expires_at)``, null project and ecosystem match all; ``risk`` is a code or its prefix.
    """
    day = F.try_to_date("expires_at", "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.expr("try_to_date(expires_at)")
    state = F.when(day.isNull() | (F.coalesce(F.trim("reason"), F.lit("")) == "") | (F.coalesce(F.trim("owner"), F.lit("")) == ""), "invalid").when(day < F.lit(today).cast("date"), "expired").otherwise("valid")
    judged = exemptions.withColumn("state", state)
    e = judged.where("state = 'valid'").alias("e")
    f = findings.alias("f")
    on = (F.col("f.package") == F.col("e.package")) & F.col("f.code").startswith(F.col("e.risk")) & (F.col("e.project_id").isNull() | (F.col("e.project_id") == F.col("f.project_id"))) & (F.col("e.ecosystem").isNull() | (F.lower("e.ecosystem") == F.lower("f.ecosystem")))
    used = f.join(e, on).groupBy("f.finding_id").agg(F.min("e.ord").alias("exemption"))
    return findings.join(used, "finding_id", "left"), judged.where("state <> 'valid'").select("ord", "state")


def completeness(capabilities: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """``(project_id, complete)``: every capability complete and no diagnostic of severity error."""
    caps = capabilities.groupBy("project_id").agg(F.bool_and(F.col("state") == "complete").alias("all_complete"))
    errors = diagnostics.where("severity = 'error'").select("project_id").distinct().withColumn("failed", F.lit(True))
    return caps.join(errors, "project_id", "left").select("project_id", (F.col("all_complete") & F.col("failed").isNull()).alias("complete"))
