"""CMake File API replies as one set of relations: from each index to its code model, its configurations, their targets and what these link to.

References are followed by joins, so that a reply folder is one of many and a target's file, which several configurations
name, is read once. Each step has a status: ``reported``, ``missing`` (no such file), ``malformed`` (not such a document),
``disagrees`` (a document that is another's) or ``outside`` (a reference that leaves its folder, never followed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.lineage import cut, written

from .files import folder

_VERSION = "struct<major:int,minor:int>"
_ENTRY = "array<struct<id:string,name:string,jsonFile:string>>"
#: The lists of a target that refer to targets, by what they say.
RELATIONS = {
    "dependencies": "order", "linkLibraries": "link", "interfaceLinkLibraries": "interface-link", "compileDependencies": "compile", "interfaceCompileDependencies": "interface-compile",
    "objectDependencies": "object", "orderDependencies": "direct-order",
}
_INDEX = f"objects array<struct<kind:string,version:{_VERSION},jsonFile:string>>"
_MODEL = f"kind string, version {_VERSION}, configurations array<struct<name:string,targets:{_ENTRY},abstractTargets:{_ENTRY}>>"
_TARGET = f"id string, name string, type string, abstract boolean, codemodelVersion {_VERSION}, " + ", ".join(f"{n} array<struct<id:string,fragment:string,fromDependency:struct<id:string>>>" for n in RELATIONS)


def _document(schema: str) -> Column:
    """The text as a document of ``schema``; null where it is no JSON object."""
    return F.when(F.col("text").rlike(r"^[ \t\n\r]*\{") & F.try_parse_json("text").isNotNull(), F.from_json("text", schema))


def _place(home: Column, reference: Column) -> Column:
    """The path that a reply refers to; null for a reference that isn't a plain name of its own folder."""
    plain = reference.rlike(r"^[^/\\:]+$") & ~reference.isin(".", "..")
    return F.when(plain, F.when(home == ".", reference).otherwise(F.concat_ws("/", home, reference)))


def model(files: DataFrame) -> dict[str, DataFrame]:
    """Relations of the replies among ``files(path, text)``:

    * ``models(index, model, status, major, minor)``: a row for each index that names one code model of version 2;
    * ``targets(index, configuration, id, name, collection, kind, status)``: what the configurations list, the first of equal ids;
    * ``relationships(index, configuration, parent, relation, ordinal, child, fragment, present, child_status, from_id, from_present)``: what reported
      targets say; ``present`` is null for a fragment, which is no target;
    * ``problems(index, code, subject)``: everything that isn't as it should be; a repeated configuration or target counts once.

    An index that is malformed or names none or several code models gives a problem alone. Of configurations with equal names the first is taken.
    Null texts are malformed; empty tables give empty relations. Files that no index leads to aren't read.
    """
    name = F.substring_index("path", "/", -1)
    index = F.coalesce(name.rlike(r"^index-.*\.json$"), F.lit(False)).cast("int")
    kept = written(files.select("path", "text", index.alias("is_index")), "is_index")  # each step below reads files again
    files = kept.select("path", "text")
    listed = kept.where("is_index = 1").select(F.col("path").alias("index"), _document(_INDEX).alias("d"))
    wanted = F.filter("d.objects", lambda o: (o["kind"] == "codemodel") & (o["version"]["major"] == 2))
    listed = cut(listed.select("index", F.col("d").isNotNull().alias("read"), F.coalesce(wanted, F.array().cast("array<struct<kind:string,version:struct<major:int,minor:int>,jsonFile:string>>")).alias("w")))
    lost = listed.where(F.size("w") != 1).select("index", F.when(F.col("read"), "index.codemodels").otherwise("index.malformed").alias("code"), F.when(F.col("read"), F.size("w").cast("string")).alias("subject"))
    chosen = listed.where(F.size("w") == 1).select("index", F.col("w")[0]["version"].alias("v"), F.col("w")[0]["jsonFile"].alias("reference"), _place(folder(F.col("index")), F.col("w")[0]["jsonFile"]).alias("path"))
    read = files.join(chosen.select("path").distinct(), "path", "left_semi").select("path", F.lit(True).alias("there"), _document(_MODEL).alias("d"))
    agrees = F.col("d.version").eqNullSafe(F.col("v"))
    found = chosen.join(read, "path", "left").withColumn("status", _status(F.col("path"), F.col("there"), (F.col("d.kind") == "codemodel") & F.col("d.configurations").isNotNull(), agrees))
    found = cut(found.select("index", "path", "reference", "status", "v", F.when(F.col("status") == "reported", F.col("d.configurations")).alias("configurations")))
    models = found.select("index", F.coalesce("path", "reference").alias("model"), "status", F.col("v.major").alias("major"), F.col("v.minor").alias("minor"))

    each = found.select("index", folder(F.col("path")).alias("home"), F.posexplode("configurations").alias("at", "c")).withColumn("configuration", F.coalesce("c.name", F.lit("")))
    each = each.groupBy("index", "configuration").agg(F.min_by(F.struct("home", "c"), "at").alias("x"), F.count("*").alias("n"))
    several = each.where("n > 1").select("index", F.lit("configuration.repeated").alias("code"), F.col("configuration").alias("subject"))
    entries = lambda field: F.transform(F.coalesce(F.col(f"x.c.{field}"), F.array().cast(_ENTRY)), lambda e: F.struct(F.lit(field).alias("collection"), e.alias("e")))
    rows = each.select("index", "configuration", "x.home", F.posexplode(F.concat(entries("targets"), entries("abstractTargets"))).alias("at", "t")).select(
        "index", "configuration", "at", F.col("t.e.id").alias("id"), F.col("t.e.name").alias("name"), "t.collection", _place(F.col("home"), F.col("t.e.jsonFile")).alias("path")
    )
    nameless = rows.where("id is null").select("index", F.lit("target.nameless").alias("code"), "configuration")
    first = rows.where("id is not null").groupBy("index", "configuration", "id").agg(F.min_by(F.struct("name", "collection", "path"), "at").alias("t"), F.count("*").alias("n"))
    first = cut(first.select("index", "configuration", "id", "t.name", "t.collection", "t.path", "n"))
    repeated = first.where("n > 1").select("index", F.lit("target.repeated").alias("code"), F.concat_ws("/", "configuration", "id").alias("subject"))

    details = files.join(first.select("path").distinct(), "path", "left_semi").select("path", F.lit(True).alias("there"), _document(_TARGET).alias("d"))
    joined = first.join(details, "path", "left").withColumn("status", _status(F.col("path"), F.col("there"), F.col("d.id").isNotNull(), (F.col("d.id") == F.col("id")) & F.col("d.name").eqNullSafe(F.col("name"))))
    joined = cut(joined.select("index", "configuration", "id", "name", "collection", "status", F.when(F.col("status") == "reported", F.col("d")).alias("d")))
    targets = joined.select("index", "configuration", "id", "name", "collection", F.col("d.type").alias("kind"), "status")

    said = lambda field, relation: F.transform(F.coalesce(F.col(f"d.{field}"), F.array().cast("array<struct<id:string,fragment:string,fromDependency:struct<id:string>>>")), lambda e, i: F.struct(F.lit(relation).alias("relation"), i.alias("ordinal"), e.alias("e")))
    links = joined.select("index", "configuration", F.col("id").alias("parent"), F.explode(F.concat(*[said(f, r) for f, r in RELATIONS.items()])).alias("s")).select(
        "index", "configuration", "parent", "s.relation", "s.ordinal", F.col("s.e.id").alias("child"), F.col("s.e.fragment").alias("fragment"), F.col("s.e.fromDependency.id").alias("from_id")
    )
    known = targets.select("index", "configuration", F.col("id").alias("child"), F.col("status").alias("child_status"))
    origin = targets.select("index", "configuration", F.col("id").alias("from_id"), F.lit(True).alias("from_there"))
    links = links.join(known, ["index", "configuration", "child"], "left").join(origin, ["index", "configuration", "from_id"], "left")
    relationships = links.select(
        "index", "configuration", "parent", "relation", "ordinal", "child", "fragment", F.when(F.col("child").isNotNull(), F.col("child_status").isNotNull()).alias("present"),
        F.when(F.col("child").isNotNull(), F.coalesce("child_status", F.lit("absent"))).alias("child_status"), "from_id", F.when(F.col("from_id").isNotNull(), F.coalesce("from_there", F.lit(False))).alias("from_present"),
    )

    dangling = relationships.where("not present").select("index", "configuration", "parent", "child").unionByName(relationships.where("not from_present").select("index", "configuration", "parent", F.col("from_id").alias("child"))).distinct()
    odd = joined.where((F.col("status") == "reported") & (F.coalesce("d.abstract", F.lit(False)) != (F.col("collection") == "abstractTargets")))
    problems = (
        lost.unionByName(models.where("status <> 'reported'").select("index", F.concat(F.lit("model."), "status").alias("code"), F.col("model").alias("subject")))
        .unionByName(several)
        .unionByName(repeated)
        .unionByName(nameless.withColumnRenamed("configuration", "subject"))
        .unionByName(targets.where("status <> 'reported'").select("index", F.concat(F.lit("target."), "status").alias("code"), F.concat_ws("/", "configuration", "id").alias("subject")))
        .unionByName(odd.select("index", F.lit("target.collection").alias("code"), F.concat_ws("/", "configuration", "id").alias("subject")))
        .unionByName(dangling.select("index", F.lit("relationship.dangling").alias("code"), F.concat_ws("/", "configuration", "parent", "child").alias("subject")))
    )
    return {"models": models, "targets": targets, "relationships": relationships, "problems": problems}


def _status(path: Column, there: Column, whole: Column, agrees: Column) -> Column:
    """What became of a reference, in the order of its steps."""
    return F.when(path.isNull(), "outside").when(there.isNull(), "missing").when(~F.coalesce(whole, F.lit(False)), "malformed").when(~F.coalesce(agrees, F.lit(False)), "disagrees").otherwise("reported")
