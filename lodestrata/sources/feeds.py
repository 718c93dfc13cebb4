"""Inventories, advisories and risk feeds by Spark's own readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "array<map<string,string>>"
OSV = f"id string, modified string, withdrawn string, aliases array<string>, affected array<struct<package:struct<ecosystem:string,name:string,purl:string>, versions:array<string>, ranges:array<struct<type:string, events:{EVENTS}>>>>"


def osv(spark: SparkSession, path: str) -> DataFrame:
    """OSV records, one to a file or in a ``records`` list: a row for each affected package.

    ``(advisory, modified, withdrawn, aliases, ecosystem, package, versions, ranges)``; ranges of type GIT are left
    out, an event has exactly one entry.
    """
    raw = spark.read.schema(f"{OSV}, records array<struct<{OSV.replace(' string', ':string').replace(' array', ':array')}>>").json(path, multiLine=True)
    own = raw.where("records is null").drop("records")
    rows = own.unionByName(raw.where("records is not null").select(F.inline("records")))
    each = rows.select(F.col("id").alias("advisory"), F.to_timestamp("modified").alias("modified"), F.to_timestamp("withdrawn").alias("withdrawn"), "aliases", F.explode("affected").alias("a"))
    kinds = F.filter("a.ranges", lambda r: F.coalesce(r["type"], F.lit("")) != "GIT")
    ranges = F.transform(kinds, lambda r: F.transform(r["events"], lambda e: F.struct(F.map_values(e)[0].alias("boundary"), F.map_keys(e)[0].alias("kind"))))
    return each.select("advisory", "modified", "withdrawn", "aliases", F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("package"), "a.versions", ranges.alias("ranges"))


def scan_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Resolved rows of canonical scan JSON: ``(identity, ecosystem, package, version, direct, public)``."""
    schema = "inventory struct<resolved_dependencies:array<struct<identity:struct<project_id:string,ecosystem:string,package:string,version:string,instance:string>,direct:boolean,origin:struct<public:boolean,kind:string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("inventory.resolved_dependencies").alias("r"))
    return rows.select(F.to_json("r.identity").alias("identity"), "r.identity.ecosystem", "r.identity.package", "r.identity.version", "r.direct", F.col("r.origin.public").alias("public"))


CYCLONEDX = "bomFormat string, specVersion string, components array<struct<`bom-ref`:string,name:string,version:string,purl:string,licenses:array<struct<expression:string,license:struct<id:string,name:string>>>>>, dependencies array<struct<ref:string,dependsOn:array<string>>>"


def cyclonedx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components ``(ref, name, version, purl)``, edges ``(parent, child)`` between them, and dangling edges of CycloneDX JSON 1.4 to 1.7."""
    doc = spark.read.schema(CYCLONEDX).json(path, multiLine=True).where("bomFormat = 'CycloneDX' and specVersion in ('1.4', '1.5', '1.6', '1.7')")
    components = doc.select(F.explode("components").alias("c")).select(F.col("c.bom-ref").alias("ref"), "c.name", "c.version", "c.purl")
    wanted = doc.select(F.explode("dependencies").alias("d")).select(F.col("d.ref").alias("parent"), F.explode("d.dependsOn").alias("child"))
    known = components.select(F.col("ref").alias("child")).distinct()
    return components, wanted.join(known, "child", "left_semi").select("parent", "child"), wanted.join(known, "child", "left_anti").select("parent", "child")


def sbom_quality(components: DataFrame) -> DataFrame:
    """How many components report each field."""
    fields = [c for c in components.columns]
    return components.agg(F.count("*").alias("n_components"), *[F.count_if(F.col(c).isNotNull()).alias(f"n_{c}") for c in fields])


def kev(spark: SparkSession, path: str) -> DataFrame:
    """A KEV catalogue: ``(cve, date_added, due_date, ransomware)``; raises where ``count`` isn't the number of entries."""
    schema = "catalogVersion string, dateReleased string, count int, vulnerabilities array<struct<cveID:string,dateAdded:string,dueDate:string,knownRansomwareCampaignUse:string>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    checked = doc.withColumn("vulnerabilities", F.when(F.size("vulnerabilities") == F.col("count"), F.col("vulnerabilities")).otherwise(F.raise_error(F.lit("KEV count differs from its entries"))))
    return checked.select(F.explode("vulnerabilities").alias("v")).select(F.col("v.cveID").alias("cve"), F.to_date("v.dateAdded").alias("date_added"), F.to_date("v.dueDate").alias("due_date"), F.col("v.knownRansomwareCampaignUse").alias("ransomware"))


def epss(spark: SparkSession, path: str) -> DataFrame:
    """An EPSS file, plain or gzip: ``(cve, score, percentile)``; scores outside 0 to 1 are null."""
    rows = spark.read.csv(path, header=True, comment="#", schema="cve string, epss string, percentile string")
    bound = lambda c: F.when(F.expr(f"try_cast({c} as decimal(38,18))").between(0, 1), F.expr(f"try_cast({c} as double)"))
    return rows.select("cve", bound("epss").alias("score"), bound("percentile").alias("percentile"))


def risk_context(references: DataFrame, kev_rows: DataFrame, epss_rows: DataFrame) -> DataFrame:
    """``references(identity, cve)`` with KEV and EPSS columns; ``kev_status`` listed or not-listed. Equal duplicates of a feed count once."""
    k = kev_rows.groupBy("cve").agg(F.min("date_added").alias("kev_added"), F.lit("listed").alias("kev_status"))
    e = epss_rows.groupBy("cve").agg(F.max("score").alias("epss"), F.max("percentile").alias("epss_percentile"))
    return references.join(k, "cve", "left").join(e, "cve", "left").withColumn("kev_status", F.coalesce("kev_status", F.lit("not-listed")))


def vex(spark: SparkSession, path: str) -> DataFrame:
    """OpenVEX statements by product: ``(vulnerability, product, status, justification)``."""
    schema = "statements array<struct<vulnerability:struct<name:string>,products:array<struct<`@id`:string>>,status:string,justification:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("statements").alias("s"))
    return rows.select(F.col("s.vulnerability.name").alias("vulnerability"), F.explode("s.products").alias("p"), "s.status", "s.justification").select("vulnerability", F.col("p.@id").alias("product"), "status", "justification")
