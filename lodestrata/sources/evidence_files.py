"""External evidence documents by Spark's readers: CVE, attestations, pip reports, scorecards, govulncheck, CMake models, CWE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cve(spark: SparkSession, path: str) -> DataFrame:
    """CVE JSON 5 records: ``(cve, state, container, provider, title)``, the CNA's container and each ADP's."""
    inner = "struct<providerMetadata:struct<shortName:string>,title:string>"
    doc = spark.read.schema(f"cveMetadata struct<cveId:string,state:string>, containers struct<cna:{inner},adp:array<{inner}>>").json(path, multiLine=True)
    tag = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("c"))
    each = doc.select("cveMetadata", F.explode(F.concat(F.array(tag("cna", F.col("containers.cna"))), F.transform(F.coalesce("containers.adp", F.array().cast(f"array<{inner}>")), lambda a: tag("adp", a)))).alias("x"))
    return each.select(F.col("cveMetadata.cveId").alias("cve"), F.col("cveMetadata.state").alias("state"), F.col("x.kind").alias("container"), F.col("x.c.providerMetadata.shortName").alias("provider"), F.col("x.c.title").alias("title"))


def attestations(spark: SparkSession, path: str) -> DataFrame:
    """in-toto statements in DSSE envelopes, a line each: ``(predicate_type, subject, sha256)``."""
    schema = "predicateType string, subject array<struct<name:string,digest:map<string,string>>>"
    doc = spark.read.schema("payload string, payloadType string").json(path).select(F.from_json(F.unbase64("payload").cast("string"), schema).alias("s")).where("s is not null")
    return doc.select(F.col("s.predicateType").alias("predicate_type"), F.explode("s.subject").alias("x")).select("predicate_type", F.col("x.name").alias("subject"), F.col("x.digest")["sha256"].alias("sha256"))


def pip_report(spark: SparkSession, path: str) -> DataFrame:
    """pip install and inspect reports: ``(package, version, requested, requires)``."""
    item = "struct<metadata:struct<name:string,version:string,requires_dist:array<string>>,requested:boolean>"
    doc = spark.read.schema(f"install array<{item}>, installed array<{item}>").json(path, multiLine=True)
    return doc.select(F.explode(F.coalesce("install", "installed")).alias("i")).select(F.col("i.metadata.name").alias("package"), F.col("i.metadata.version").alias("version"), F.coalesce("i.requested", F.lit(False)).alias("requested"), F.col("i.metadata.requires_dist").alias("requires"))


def scorecard(spark: SparkSession, path: str) -> DataFrame:
    """Scorecard results: ``(repository, check, score)``; a negative score is none."""
    doc = spark.read.schema("repo struct<name:string>, checks array<struct<name:string,score:double>>").json(path, multiLine=True)
    return doc.select(F.col("repo.name").alias("repository"), F.explode("checks").alias("c")).select("repository", F.col("c.name").alias("check"), F.when(F.col("c.score") >= 0, F.col("c.score")).alias("score"))


def govulncheck(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a govulncheck stream (concatenated objects): ``(ordinal, osv, module, version, called)``."""
    text = spark.read.text(path, wholetext=True)
    objects = text.select(F.posexplode(F.split("value", r"(?m)(?<=^\})\s*(?=^\{)|(?<=\})\n(?=\{)")).alias("ordinal", "o"))
    row = F.from_json("o", "finding struct<osv:string,trace:array<struct<module:string,version:string,function:string>>>")
    return objects.select("ordinal", row.alias("r")).where("r.finding is not null").select("ordinal", F.col("r.finding.osv").alias("osv"), F.col("r.finding.trace")[0]["module"].alias("module"), F.col("r.finding.trace")[0]["version"].alias("version"), F.exists("r.finding.trace", lambda t: t["function"].isNotNull()).alias("called"))


def cmake_targets(spark: SparkSession, replies: str) -> tuple[DataFrame, DataFrame]:
    """Targets ``(id, name, kind)`` of the target files in a reply folder and their relationships ``(parent, child, present)``; ``cmake_model`` follows replies from their index."""
    doc = spark.read.schema("id string, name string, type string, dependencies array<struct<id:string>>").option("pathGlobFilter", "target-*.json").json(replies, multiLine=True)
    targets = doc.select("id", "name", F.col("type").alias("kind"))
    wanted = doc.select(F.col("id").alias("parent"), F.explode("dependencies").alias("d")).select("parent", F.col("d.id").alias("child"))
    known = targets.select(F.col("id").alias("child"), F.lit(True).alias("there"))
    return targets, wanted.join(known, "child", "left").select("parent", "child", F.coalesce("there", F.lit(False)).alias("present"))


def cwe(spark: SparkSession, path: str) -> DataFrame:
    """A CWE catalogue: ``(cwe, name, status)``."""
    rows = spark.read.schema("_ID string, _Name string, _Status string").option("rowTag", "Weakness").xml(path)
    return rows.select(F.concat(F.lit("CWE-"), F.col("_ID")).alias("cwe"), F.col("_Name").alias("name"), F.col("_Status").alias("status"))
