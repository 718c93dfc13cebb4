"""Manifests, locks and sources to evidence rows.

Each function takes ``files(path, text)`` and gives rows with ``path``. Line and JSON formats are read by
column expressions; TOML, YAML and Python source by a small helper within ``mapInArrow``. A file that
doesn't parse gives no rows (``problems`` lists it), so missing evidence is never read as absence.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.checks import inside
from lodestrata.functions.text import pypi_name
from lodestrata.lineage import Grown, cut, merged
from lodestrata.operators import substitution
from lodestrata.operators.compare import occurrences
from lodestrata.operators.graph import longest_levels

from . import lexer
from .files import folder, numbered_lines

#: The forms of a requirement line, by name and by name and address.
REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[([^\]]*)\])?\s*((?:(?:===|==|~=|!=|<=|>=|<|>)\s*[^;#,\s]+\s*,?\s*)*)(?:;\s*([^#]*?))?\s*(?:\s#.*)?$"
DIRECT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[([^\]]*)\])?\s*@\s*(\S+)(?:\s+;\s*([^#]*?))?\s*(?:\s#.*)?$"
OPTION = r"\s--(?:hash|global-option|config-settings|install-option)[ =]\S+"


def requirements(files: DataFrame) -> DataFrame:
    """requirements.txt: ``(path, line, package, display_name, extras, constraint_raw, marker, url)``.

    Continued lines are joined and keep the number of their first physical line; options of a line (``--hash`` and the like) are
    taken off, option lines skipped. ``name @ address`` has no constraint but a ``url``.
    """
    # a line that ends in a backslash goes on in the next: joined before lines are cut, and counted for the numbers of those after it
    joint = "\u0001"
    joined = F.regexp_replace(F.regexp_replace("text", r"\\\n", joint), r"\\(?=\n|\z)", " ")
    marked = files.where("text is not null").select("path", F.monotonically_increasing_id().alias("file"), joined.alias("joined"))
    lines = marked.select("path", "file", F.posexplode(F.split("joined", "\n")).alias("at", "text"))
    before = F.sum(F.length("text") - F.length(F.replace("text", F.lit(joint), F.lit("")))).over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    glued = lines.select("path", (F.col("at") + 1 + F.coalesce(before, F.lit(0))).cast("int").alias("line"), F.replace("text", F.lit(joint), F.lit(" ")).alias("text"))
    rows = glued.withColumn("text", F.regexp_replace("text", OPTION, "")).where(~F.col("text").rlike(r"^\s*(#|-|$)"))
    part = lambda rule, i: F.trim(F.regexp_extract("text", rule, i))
    direct = F.col("text").rlike(DIRECT)
    either = lambda i: F.when(direct, part(DIRECT, i)).otherwise(part(REQUIREMENT, i))
    extras, marker = either(2), either(4)
    return rows.where(direct | F.col("text").rlike(REQUIREMENT)).select(
        "path", "line", pypi_name(either(1)).alias("package"), either(1).alias("display_name"), F.when(extras != "", F.split(extras, r"\s*,\s*")).alias("extras"),
        F.when(direct, "").otherwise(part(REQUIREMENT, 3)).alias("constraint_raw"), F.when(marker != "", marker).alias("marker"), F.when(direct, part(DIRECT, 3)).alias("url"),
    )


def includes(files: DataFrame) -> DataFrame:
    """``(path, target, kind)`` of -r and -c lines; targets are relative to the file's folder."""
    rows = numbered_lines(files).where(F.col("text").rlike(r"^\s*(-r|-c|--requirement|--constraint)[ =]"))
    target = F.regexp_extract("text", r"^\s*(?:-r|-c|--requirement|--constraint)[ =]\s*(\S+)", 1)
    full = F.when(folder(F.col("path")) == ".", target).otherwise(F.concat(folder(F.col("path")), F.lit("/"), target))
    return rows.select("path", full.alias("target"), F.when(F.col("text").rlike(r"^\s*(-c|--constraint)"), "constraint").otherwise("requirement").alias("kind"))


def include_closure(files: DataFrame, roots: DataFrame, rounds: int = 1000) -> DataFrame:
    """``(root, path, kind, depth, status, endless)``: what each requirements file of ``roots(path)`` includes, itself at depth 0.

    Rounds of joins on new (root, file, kind) rows alone, so cycles end. What a constraint file includes is a constraint too;
    a file reached as both has two rows, each with its least depth. ``status`` is found, missing, or outside for a target that
    leaves the root folder (its ``path`` is the text as given); ``endless`` tells whether a file is in or leads into a cycle of includes.
    """
    edges = includes(files).withColumn("inner", inside(F.col("target")))
    edges = merged(cut(edges.select("path", F.coalesce("inner", "target").alias("target"), F.col("inner").isNull().alias("out"), "kind").distinct()))
    front = merged(cut(roots.select(F.col("path").alias("root"), "path", F.lit("requirement").alias("kind"), F.lit(False).alias("out")).distinct().withColumn("depth", F.lit(0))))
    seen = Grown(front)
    for step in range(1, rounds + 1):
        kind = F.when((F.col("f.kind") == "constraint") | (F.col("e.kind") == "constraint"), "constraint").otherwise("requirement")
        found = front.alias("f").where("not out").join(edges.alias("e"), F.col("f.path") == F.col("e.path")).select("f.root", F.col("e.target").alias("path"), kind.alias("kind"), "e.out").distinct()
        front = merged(cut(found.join(merged(seen.rows().select("root", "path", "kind")), ["root", "path", "kind"], "left_anti").withColumn("depth", F.lit(step))))
        if front.isEmpty():
            break
        seen.add(front)
    else:
        raise RuntimeError(f"includes go deeper than {rounds} files")
    there = files.select("path").distinct().withColumn("there", F.lit(True))
    ends = edges.where("not out").select(F.col("path").alias("node"), F.col("target").alias("dep"))
    round_ = longest_levels(ends.select("node").union(ends.select("dep")), ends).where("level is null").select(F.col("node").alias("path"), F.lit(True).alias("endless"))
    status = F.when(F.col("out"), "outside").when(F.col("there"), "found").otherwise("missing")
    return seen.rows().join(merged(there), "path", "left").join(merged(round_), "path", "left").select("root", "path", "kind", "depth", status.alias("status"), F.coalesce("endless", F.lit(False)).alias("endless"))


#: Sections of package.json and their scopes.
NPM_SECTIONS = {"dependencies": "runtime", "devDependencies": "development", "peerDependencies": "peer", "optionalDependencies": "optional"}


def package_json(files: DataFrame) -> DataFrame:
    """package.json: ``(path, package, constraint_raw, scope)``; an optional dependency replaces a plain one of its name."""
    schema = ", ".join(f"{s} map<string,string>" for s in NPM_SECTIONS)
    parsed = files.select("path", F.from_json("text", schema).alias("j"))
    rows = None
    for section, scope in NPM_SECTIONS.items():
        own = parsed.select("path", F.explode(f"j.{section}").alias("package", "constraint_raw")).withColumn("scope", F.lit(scope))
        rows = own if rows is None else rows.union(own)
    optional = rows.where("scope = 'optional'").select("path", "package").withColumn("o", F.lit(True))
    return rows.join(merged(optional), ["path", "package"], "left").where("scope <> 'runtime' or o is null").select("path", "package", "constraint_raw", "scope")


def package_lock(files: DataFrame) -> DataFrame:
    """package-lock v2 and v3: ``(path, instance, package, version, integrity, direct, requests)``, an instance for each ``packages`` entry."""
    schema = "lockfileVersion int, packages map<string, struct<name:string, version:string, integrity:string, link:boolean, dependencies:map<string,string>, devDependencies:map<string,string>>>"
    rows = files.select("path", F.from_json("text", schema).alias("j")).where("j.lockfileVersion in (2, 3)").select("path", F.explode("j.packages").alias("instance", "p"))
    name = F.coalesce("p.name", F.when(F.col("instance") != "", F.substring_index("instance", "node_modules/", -1)))
    return rows.select("path", "instance", name.alias("package"), "p.version", "p.integrity", F.col("instance").rlike("^node_modules/(@[^/]+/)?[^/]+$").alias("direct"), F.map_concat(F.coalesce("p.dependencies", F.create_map().cast("map<string,string>")), F.create_map().cast("map<string,string>")).alias("requests"))


def package_lock_v1(files: DataFrame) -> DataFrame:
    """package-lock v1 in the columns of ``package_lock``: nested ``dependencies`` become ``node_modules`` paths, ``requires`` requests."""

    def read(text: str) -> list[tuple]:
        doc, out = json.loads(text), []
        if doc.get("lockfileVersion", 1) != 1:
            return []

        def walk(table: dict, at: str) -> None:
            for name, d in table.items():
                own = f"{at}node_modules/{name}"
                wants = d.get("requires") if isinstance(d.get("requires"), dict) else {}
                out.append((own, name, d.get("version"), d.get("integrity"), str(not at).lower(), json.dumps(wants, sort_keys=True)))
                walk(d.get("dependencies") or {}, f"{own}/")

        walk(doc.get("dependencies") or {}, "")
        return out

    names = ["instance", "package", "version", "integrity", "direct", "requests"]
    rows = _rows(files, ", ".join(f"{n} string" for n in names), names, read)
    return rows.where("problem is null").select("path", "instance", "package", "version", "integrity", (F.col("direct") == "true").alias("direct"), F.from_json("requests", "map<string,string>").alias("requests"))


def npmrc(files: DataFrame) -> DataFrame:
    """.npmrc: ``(path, scope, registry)``; ``scope`` is empty for the default registry, the last line of a key counts, secrets aren't read."""
    rule = r"^\s*(?:(@[^:\s]+):)?registry\s*=\s*(\S+)\s*$"
    rows = numbered_lines(files).where(F.col("text").rlike(rule)).select("path", F.regexp_extract("text", rule, 1).alias("scope"), F.regexp_replace(F.regexp_extract("text", rule, 2), "/+$", "").alias("registry"), "line")
    return rows.groupBy("path", "scope").agg(F.max_by("registry", "line").alias("registry"))


def npm_origins(packages: DataFrame, registries: DataFrame, public: str = "https://registry.npmjs.org") -> DataFrame:
    """``packages(path, package)`` with the ``registry`` of their scope, else the file's default, else the public one, and whether that is ``public``."""
    scope = F.when(F.col("package").startswith("@"), F.substring_index("package", "/", 1)).otherwise("")
    own = registries.where("scope <> ''").select("path", "scope", F.col("registry").alias("own"))
    default = registries.where("scope = ''").select("path", F.col("registry").alias("default"))
    rows = packages.withColumn("scope", scope).join(own, ["path", "scope"], "left").join(default, "path", "left")
    registry = F.coalesce("own", "default", F.lit(public))
    return rows.select(*packages.columns, registry.alias("registry"), (registry == public).alias("public"))


def npm_edges(instances: DataFrame) -> DataFrame:
    """``(path, parent, child, request, target)``: each request bound to the nearest ``node_modules`` that has it, else null.

    Ancestors of an instance explode with their depth; one equi join and a maximum find the nearest. The join is a merge: instances
    are many for each row that they come from, so an estimate by that table's size would broadcast them. The depth is the maximum, not the
    text, so that groups are hashed, not sorted.
    """
    wanted = instances.select("path", F.col("instance").alias("parent"), F.explode("requests").alias("child", "request"))
    parts = F.split("parent", "/node_modules/")
    at = F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/node_modules/")
    spot = F.when(at == "", F.concat(F.lit("node_modules/"), F.col("child"))).otherwise(F.concat(at, F.lit("/node_modules/"), "child"))
    spots = wanted.select("*", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("spot", spot)
    found = spots.join(instances.select("path", F.col("instance").alias("spot"), F.lit(True).alias("there")).hint("merge"), ["path", "spot"], "left")
    nearest = found.groupBy("path", "parent", "child", "request").agg(F.max(F.when(F.col("there"), F.col("depth"))).alias("depth"))
    return nearest.select("path", "parent", "child", "request", F.when(F.col("depth").isNotNull(), spot).alias("target"))


def go_mod(files: DataFrame) -> DataFrame:
    """go.mod requirements: ``(path, package, version, indirect)``, from blocks and single lines."""
    bare = F.regexp_replace("text", r"(?m)//(?! indirect).*$", "")
    block = F.array_join(F.regexp_extract_all(bare, F.lit(r"(?ms)^\s*require\s*\(\s*(.*?)^\s*\)"), F.lit(1)), "\n")
    single = F.array_join(F.regexp_extract_all(bare, F.lit(r"(?m)^\s*require[ \t]+([^(\s].*)$"), F.lit(1)), "\n")
    rows = files.select("path", F.explode(F.split(F.concat_ws("\n", block, single), "\n")).alias("l")).withColumn("l", F.regexp_replace("l", r"^\s+|\s+$", "")).where(F.col("l").rlike(r'^\S+\s+v\S+'))
    return rows.select("path", F.regexp_replace(F.regexp_extract("l", r"^(\S+)", 1), '"', "").alias("package"), F.regexp_extract("l", r"^\S+\s+(v\S+)", 1).alias("version"), F.col("l").contains("// indirect").alias("indirect"))


def go_replaces(files: DataFrame) -> DataFrame:
    """go.mod replace and exclude directives: ``(path, kind, package, version, target, target_version)``, from blocks and single lines."""
    bare = F.regexp_replace("text", r"(?m)//.*$", "")
    out = None
    for kind in ("replace", "exclude"):
        block = F.array_join(F.regexp_extract_all(bare, F.lit(rf"(?ms)^\s*{kind}\s*\(\s*(.*?)^\s*\)"), F.lit(1)), "\n")
        single = F.array_join(F.regexp_extract_all(bare, F.lit(rf"(?m)^\s*{kind}[ \t]+([^(\s].*)$"), F.lit(1)), "\n")
        rows = files.select("path", F.lit(kind).alias("kind"), F.explode(F.split(F.concat_ws("\n", block, single), "\n")).alias("l")).withColumn("l", F.regexp_replace("l", r"^\s+|\s+$", "")).where("l <> ''")
        out = rows if out is None else out.union(rows)
    side = F.split(F.col("l"), r"\s*=>\s*")
    word = lambda c, i: F.nullif(F.regexp_extract(c, r"^(\S+)(?:\s+(\S+))?", i), F.lit(""))
    target = F.coalesce(F.try_element_at(side, F.lit(2)), F.lit(""))
    return out.select("path", "kind", word(side[0], 1).alias("package"), word(side[0], 2).alias("version"), word(target, 1).alias("target"), word(target, 2).alias("target_version"))


def go_sum(files: DataFrame) -> DataFrame:
    """go.sum: ``(path, line, package, version, checksum)``; lines for a module's go.mod keep ``/go.mod`` in the version."""
    rows = numbered_lines(files).withColumn("p", F.split(F.trim("text"), r"\s+")).where(F.size("p") == 3)
    return rows.select("path", "line", F.col("p")[0].alias("package"), F.col("p")[1].alias("version"), F.col("p")[2].alias("checksum"))


def gradle_lockfile(files: DataFrame) -> DataFrame:
    """gradle.lockfile: ``(path, line, package, version, configuration, instance)``, a numbered instance for each assertion."""
    rows = numbered_lines(files).where(F.col("text").rlike(r"^[^#:=]+:[^:=]+:[^:=]+=")).withColumn("c", F.split(F.substring_index("text", "=", 1), ":"))
    rows = rows.select("path", "line", F.concat_ws(":", F.col("c")[0], F.col("c")[1]).alias("package"), F.col("c")[2].alias("version"), F.explode(F.split(F.substring_index("text", "=", -1), ",")).alias("configuration"))
    numbered = occurrences(rows, ["path", "package", "version", "configuration"], ["line"])
    return numbered.withColumn("instance", F.concat_ws("#", F.concat_ws(":", "configuration", "package", "version"), F.col("occurrence").cast("string"))).drop("occurrence")


def cargo_lock(files: DataFrame) -> DataFrame:
    """Cargo.lock: ``(path, package, version, source, checksum, requests)``; requests are ``name [version [source]]``."""
    rows = files.select("path", F.explode(F.expr(r"slice(split(text, r'(?m)^\[\[package\]\]\s*$'), 2, size(split(text, r'(?m)^\[\[package\]\]\s*$')))")).alias("b"))
    value = lambda k: F.nullif(F.regexp_extract("b", rf'(?m)^{k}\s*=\s*"([^"]*)"', 1), F.lit(""))
    requests = F.regexp_extract_all(F.regexp_extract("b", r"(?s)dependencies\s*=\s*\[(.*?)\]", 1), F.lit('"([^"]*)"'), F.lit(1))
    return rows.select("path", value("name").alias("package"), value("version").alias("version"), value("source").alias("source"), value("checksum").alias("checksum"), requests.alias("requests")).where("package is not null")


def cargo_edges(packages: DataFrame) -> DataFrame:
    """``(path, parent, parent_version, child, n_candidates, child_version)``; a version only where exactly one record fits."""
    wanted = packages.select("path", F.col("package").alias("parent"), F.col("version").alias("parent_version"), F.explode("requests").alias("r")).withColumn("p", F.split("r", " "))
    wanted = wanted.select("path", "parent", "parent_version", F.col("p")[0].alias("child"), F.try_element_at("p", F.lit(2)).alias("want"))
    right = packages.select("path", F.col("package").alias("child"), F.col("version").alias("have"))
    hits = wanted.join(right, ["path", "child"], "left").where("want is null or have = want or have is null")
    return hits.groupBy("path", "parent", "parent_version", "child", "want").agg(F.count("have").alias("n_candidates"), F.min("have").alias("v")).select("path", "parent", "parent_version", "child", "n_candidates", F.when(F.col("n_candidates") == 1, F.col("v")).alias("child_version"))


def _pom_model(text: str) -> list[tuple]:
    """Facts of one pom.xml: (fact, key, value, extra) rows for its coordinates, parent, properties, managed and own dependencies."""
    import xml.etree.ElementTree as tree

    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("a document type is refused")
    try:
        root = tree.fromstring(text)
    except tree.ParseError as e:
        raise ValueError(str(e)) from e

    def tag(node) -> str:
        return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""

    def child(node, name: str):
        return next((x for x in node if tag(x) == name), None) if node is not None else None

    def value(node, name: str) -> str | None:
        found = child(node, name)
        return (found.text or "").strip() or None if found is not None else None

    def dependencies(node) -> list:
        found = child(node, "dependencies")
        return [d for d in found if tag(d) == "dependency"] if found is not None else []

    parent = child(root, "parent")
    group = value(root, "groupId") or value(parent, "groupId")
    out = [("self", f"{group}:{value(root, 'artifactId')}", value(root, "version") or value(parent, "version"), None)]
    if parent is not None:
        out.append(("parent", f"{value(parent, 'groupId')}:{value(parent, 'artifactId')}", value(parent, "version"), None))
    out += [("property", tag(x), (x.text or "").strip(), None) for x in (child(root, "properties") if child(root, "properties") is not None else []) if tag(x)]
    out += [("managed", f"{value(d, 'groupId')}:{value(d, 'artifactId')}", value(d, "version"), value(d, "scope")) for d in dependencies(child(root, "dependencyManagement"))]
    out += [("dependency", f"{value(d, 'groupId')}:{value(d, 'artifactId')}", value(d, "version"), value(d, "scope")) for d in dependencies(root)]
    build = child(root, "build")
    for fact, node in (("plugin", child(build, "plugins")), ("managed-plugin", child(child(build, "pluginManagement"), "plugins"))):
        out += [(fact, f"{value(p, 'groupId') or 'org.apache.maven.plugins'}:{value(p, 'artifactId')}", value(p, "version"), None) for p in node if tag(p) == "plugin"] if node is not None else []
    for profile in child(root, "profiles") if child(root, "profiles") is not None else []:
        out += [("profile-dependency", f"{value(d, 'groupId')}:{value(d, 'artifactId')}", value(d, "version"), value(d, "scope")) for d in dependencies(profile)]
        out += [("profile-management", f"{value(d, 'groupId')}:{value(d, 'artifactId')}", value(d, "version"), value(d, "scope")) for d in dependencies(child(profile, "dependencyManagement"))]
    return out


def pom_facts(files: DataFrame) -> DataFrame:
    """``(path, fact, key, value, extra, problem)`` of pom.xml files, one helper call to a file; a malformed one gives its problem alone."""
    return _rows(files, "fact string, key string, value string, extra string", ["fact", "key", "value", "extra"], _pom_model)


def _pom_chain(files: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Coordinates ``(path, own, own_version)`` of pom files, and their and their ancestors' facts with ``depth``, the nearest first; to be joined by merges."""
    facts = merged(cut(pom_facts(files).where("problem is null").drop("problem")))
    selfs = facts.where("fact = 'self'").select("path", F.col("key").alias("own"), F.col("value").alias("own_version"))
    by_name = selfs.groupBy(F.col("own").alias("key")).agg(F.min("path").alias("up"))
    parents = facts.where("fact = 'parent'").select("path", "key").join(by_name, "key").select("path", "up").where("path <> up")
    parents = merged(cut(parents))
    chain = merged(cut(selfs.select("path", F.col("path").alias("at"), F.lit(0).alias("depth"))))
    front = chain
    for depth in range(1, rounds + 1):
        front = cut(front.join(parents.withColumnRenamed("path", "at"), "at").select("path", F.col("up").alias("at"), F.lit(depth).alias("depth")).join(chain.select("path", "at"), ["path", "at"], "left_anti"))
        if front.isEmpty():
            break
        chain = merged(cut(chain.union(front)))
    return selfs, merged(cut(chain.join(facts.withColumnRenamed("path", "at"), "at")))


def _nearest(seen: DataFrame, kind: str, *cols: str) -> DataFrame:
    return seen.where(F.col("fact") == kind).groupBy("path", "key").agg(F.min_by(F.struct(*cols), "depth").alias("n"))


def _pom_properties(selfs: DataFrame, seen: DataFrame) -> DataFrame:
    parent = _nearest(seen.where("depth = 0"), "parent", "value").select("path", F.col("key").alias("up"), F.col("n.value").alias("up_version"))
    part = lambda c, i: F.split(c, ":", 2)[i]
    names = {"groupId": part(F.col("own"), 0), "artifactId": part(F.col("own"), 1), "version": F.col("own_version"), "parent.groupId": part(F.col("up"), 0), "parent.artifactId": part(F.col("up"), 1), "parent.version": F.col("up_version")}
    given = [F.struct(F.lit(p + k).alias("key"), v.alias("value")) for k, v in names.items() for p in ("project.", "pom.", "") if p or k == "version"]
    own = selfs.join(parent, "path", "left").select("path", F.inline(F.array(*given))).where("value is not null")
    told = _nearest(seen, "property", "value").select("path", "key", F.col("n.value").alias("value"))
    return substitution.resolve(told.unionByName(own.join(told, ["path", "key"], "left_anti").select("path", "key", "value")).withColumnRenamed("path", "scope"))


def pom_properties(files: DataFrame, rounds: int = 16) -> DataFrame:
    """``(path, key, value, status)``: the properties in effect of pom.xml files, references in them filled in; see ``substitution.resolve``.

    A file's own properties go before its ancestors', these before the project's and the parent's coordinates.
    """
    return _pom_properties(*_pom_chain(files, rounds)).withColumnRenamed("scope", "path")


def pom(files: DataFrame, rounds: int = 16) -> DataFrame:
    """pom.xml dependencies and plugins in effect: ``(path, package, constraint_raw, scope, maven_kind)``.

    Parents are the files of ``files`` with the parent's coordinates, found by joins, the nearest first. Properties, managed versions
    and managed scopes come from the file itself, else from its nearest ancestor that has them; dependencies and plugins of ancestors
    are inherited. ``${...}`` anywhere in a text is filled in from the properties, which may hold references themselves; what isn't known
    or goes round stays as it is. Profiles' rows are kept apart by ``maven_kind``. A chain of parents that returns to itself, or is
    longer than ``rounds``, ends there.
    """
    selfs, seen = _pom_chain(files, rounds)
    resolved = merged(cut(_pom_properties(selfs, seen)))
    managed = _nearest(seen, "managed", "value", "extra").select("path", "key", F.lit("dependency").alias("of"), F.col("n.value").alias("managed_version"), F.col("n.extra").alias("managed_scope"))
    plugins = _nearest(seen, "managed-plugin", "value").select("path", "key", F.lit("plugin").alias("of"), F.col("n.value").alias("managed_version"), F.lit(None).cast("string").alias("managed_scope"))
    kinds = ["dependency", "profile-dependency", "profile-management", "plugin"]
    wanted = seen.where(F.col("fact").isin(*kinds)).groupBy("path", "fact", "key").agg(F.min_by(F.struct("value", "extra"), "depth").alias("n")).select("path", "fact", "key", "n.value", "n.extra", F.when(F.col("fact") == "plugin", "plugin").otherwise("dependency").alias("of"))
    rows = wanted.join(managed.unionByName(plugins), ["path", "key", "of"], "left").join(selfs, "path")  # merges, as ``seen`` and ``selfs`` say
    rows = rows.withColumn("version", F.coalesce("value", "managed_version")).withColumn("scope", F.coalesce("extra", "managed_scope", F.lit("compile")))
    rows = merged(cut(rows))  # each of the columns filled in reads them twice
    for column, name in (("key", "package"), ("version", "constraint_"), ("scope", "scope_")):
        rows = substitution.fill(rows, "path", column, resolved, name)
    scope = F.when(F.col("fact") == "plugin", "build").when(F.col("scope_") == "test", "test").when(F.col("scope_").isin("provided", "system"), "build").otherwise("runtime")
    return rows.select("path", "package", F.coalesce("constraint_", F.lit("")).alias("constraint_raw"), scope.alias("scope"), F.col("fact").alias("maven_kind"))


def vcpkg_json(files: DataFrame) -> DataFrame:
    """vcpkg.json: ``(path, package, minimum, scope)``; a plain text is a name."""
    rows = files.select("path", F.explode(F.expr("try_variant_get(try_parse_json(text), '$.dependencies', 'array<variant>')")).alias("d"))
    get = lambda k: F.expr(f"try_variant_get(d, '$.{k}', 'string')")
    plain = F.expr("case when schema_of_variant(d) = 'STRING' then cast(d as string) end")
    return rows.select("path", F.coalesce(get("name"), plain).alias("package"), F.expr("try_variant_get(d, '$[\"version>=\"]', 'string')").alias("minimum"), F.when(F.expr("try_variant_get(d, '$.host', 'boolean')"), "host").otherwise("runtime").alias("scope"))


def java_imports(files: DataFrame) -> DataFrame:
    """Java and Kotlin imports: ``(path, line, reference)``."""
    rule = r"^\s*import\s+(?:static\s+)?([A-Za-z_][\w.]*(?:\.\*)?)"
    return numbered_lines(files).where(F.col("text").rlike(rule)).select("path", "line", F.regexp_replace(F.regexp_extract("text", rule, 1), r"\.\*?$", "").alias("reference"))


#: Comments and literals of C: matched in this order from the left, so that marks within one don't open another.
_C_PIECES = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
_C_LINE = re.compile(r"""^\s*\#\s*(?:(if)|(endif)\b|include\s*(?:<([^>"]+)>|"([^>"]+)"))""")


def _c_includes(text: str) -> list[tuple]:
    bare = _C_PIECES.sub(lambda m: m[0] if m[0][0] in "\"'" else re.sub(r"[^\n]", " ", m[0]), text)
    out, depth = [], 0
    for line, found in enumerate(map(_C_LINE.match, bare.split("\n")), 1):
        if found:
            depth += (found[1] is not None) - (found[2] is not None)
            if name := found[3] or found[4]:
                out.append((line, name, str(found[4] is not None), str(depth > 0)))
    return out


def c_includes(files: DataFrame) -> DataFrame:
    """C and C++ includes: ``(path, line, reference, quoted, conditional)``; macro operands are no references.

    ``conditional`` tells whether the line stands within an ``#if``: more of them have opened than closed in the lines before it.
    Comments are blanked out with their newlines kept, so ``line`` is the file's.
    """
    rows = _rows(files.where("text is not null"), "line int, reference string, quoted string, conditional string", ["line", "reference", "quoted", "conditional"], _c_includes).where("problem is null")
    return rows.select("path", "line", "reference", F.col("quoted").cast("boolean").alias("quoted"), F.col("conditional").cast("boolean").alias("conditional"))


#: Endings of sources in which tags may stand among code.
JSX_ENDINGS = r"\.(js|jsx|tsx|mjs|cjs)$"


def js_loads(files: DataFrame, computed: bool = False) -> DataFrame:
    """Literal module loads of JavaScript and TypeScript: ``(path, line, reference, kind)``, also over several lines.

    ``kind`` is regular, dynamic (``import()``) or resolve (``require.resolve``); ``line`` is where the load begins. Strings, templates,
    regular expressions, comments and text between tags hold no loads, a template's substitutions may. With ``computed`` loads whose module isn't a
    literal are rows without a reference. Null and empty texts give none.
    """
    tags = F.col("path").rlike(JSX_ENDINGS)
    out = None
    for own, language in ((files.where(tags), "JSX"), (files.where(~tags | F.col("path").isNull()), "JAVASCRIPT")):
        rows = _rows(own, "line int, reference string, kind string", ["line", "reference", "kind"], partial(lexer.module_loads, language=language))
        out = rows if out is None else out.unionByName(rows)
    out = out.where("problem is null").drop("problem")
    return out if computed else out.where("kind <> 'computed'")


#: Node's own modules.
NODE_BUILTINS = [
    "assert", "assert/strict", "async_hooks", "buffer", "child_process", "cluster", "console", "crypto", "dgram", "diagnostics_channel", "dns", "dns/promises", "domain", "events", "fs", "fs/promises",
    "http", "http2", "https", "inspector", "inspector/promises", "module", "net", "os", "path", "path/posix", "path/win32", "perf_hooks", "process", "punycode", "querystring", "readline", "readline/promises",
    "repl", "stream", "stream/consumers", "stream/promises", "stream/web", "string_decoder", "timers", "timers/promises", "tls", "tty", "url", "util", "util/types", "v8", "vm", "wasi", "worker_threads", "zlib",
]


def npm_package(reference: str = "reference"):
    """The package of a module reference: two segments with a scope, one without, in lower case.

    None for relative ones, ``#`` aliases, Node's own modules, and references with a scheme or to another host.
    """
    c = F.trim(F.col(reference))
    none = (c == "") | c.rlike(r"^[./#]") | c.isin(*NODE_BUILTINS) | F.substring_index(c, "/", 1).contains(":")
    return F.when(none, F.lit(None)).when(c.startswith("@"), F.nullif(F.lower(F.regexp_extract(c, "^(@[^/]+/[^/]+)", 1)), F.lit(""))).otherwise(F.lower(F.substring_index(c, "/", 1)))


#: Rows of so many texts of so many characters at most are kept by a task that reads files: copies of a file are parsed once while they are near.
EQUAL_TEXTS, SHORT_TEXT = 1024, 4096


def _rows(files: DataFrame, schema: str, names: list[str], read: Callable[[str], list[tuple]]) -> DataFrame:
    """Rows of a per-file helper; a file that raises gives a row with ``problem`` alone. ``read`` must depend on the text alone."""

    def attempt(text: str) -> tuple[list[tuple], str | None]:
        try:
            return list(read(text)), None
        except ImportError:
            raise
        except Exception as e:  # whatever a file's content does to its helper is that file's problem
            return [(None,) * len(names)], f"{type(e).__name__}: {e}"[:200]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = lru_cache(EQUAL_TEXTS)(attempt)
        for batch in batches:
            paths: list[str] = []
            rows: list[tuple] = []
            problems: list[str | None] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, problem = (kept if len(text or "") <= SHORT_TEXT else attempt)(text or "")
                paths += [path] * len(found)
                rows += found
                problems += [problem] * len(found)
            columns = [paths, *(zip(*rows, strict=True) if rows else [[]] * len(names)), problems]
            cols = ["path", *names, "problem"]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if c == "line" else pa.string()) for c, v in zip(cols, columns, strict=True)], cols)

    return files.select("path", "text").mapInArrow(parse, f"path string, {schema}, problem string")


def _imports(text: str) -> list[tuple]:
    out = []

    def walk(node: ast.AST, kind: str) -> None:
        for child in ast.iter_child_nodes(node):
            own = kind
            if isinstance(child, ast.Try) and any("ImportError" in ast.dump(h.type) or "ModuleNotFoundError" in ast.dump(h.type) for h in child.handlers if h.type):
                own = "optional"
            elif isinstance(child, ast.If) and "TYPE_CHECKING" in ast.dump(child.test):
                own = "typing"
            if isinstance(child, ast.Import):
                out.extend((child.lineno, a.name, own) for a in child.names)
            elif isinstance(child, ast.ImportFrom) and not child.level and child.module:
                out.append((child.lineno, child.module, own))
            elif isinstance(child, ast.Call) and getattr(child.func, "attr", getattr(child.func, "id", "")) in ("import_module", "__import__") and child.args and isinstance(child.args[0], ast.Constant) and isinstance(child.args[0].value, str):
                out.append((child.lineno, child.args[0].value, "dynamic"))
            walk(child, own)

    walk(ast.parse(text), "regular")
    return out


def python_imports(files: DataFrame) -> DataFrame:
    """Imports of .py files and notebooks' code cells: ``(path, line, reference, kind, problem)``."""

    def read(text: str) -> list[tuple]:
        if text.lstrip().startswith("{") and '"cells"' in text:
            cells = [c for c in json.loads(text)["cells"] if c.get("cell_type") == "code"]
            text = "\n".join("" if s.startswith(("%", "!")) else s for c in cells for s in "".join(c["source"]).split("\n"))
        return _imports(text)

    return _rows(files, "line int, reference string, kind string", ["line", "reference", "kind"], read)


#: A requirement of a name and at most one plain clause, whose parts stand as the library gives them.
_PLAIN_REQUIREMENT = re.compile(r"[ \t]*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)[ \t]*(?:(==|>=|<=|!=|<|>)[ \t]*([0-9]+(?:\.[0-9]+)*))?[ \t]*").fullmatch


def _requirement(raw: str) -> tuple[str, str, str | None]:
    if m := _PLAIN_REQUIREMENT(raw):
        return m[1], (m[2] or "") + (m[3] or ""), None
    from packaging.requirements import Requirement

    r = Requirement(raw)
    return r.name, str(r.specifier), str(r.marker) if r.marker else None


def pyproject(files: DataFrame) -> DataFrame:
    """pyproject.toml: PEP 621 and PEP 735 groups, Poetry, PDM and uv tables: ``(path, display_name, constraint_raw, marker, group, problem)``."""

    def read(text: str) -> list[tuple]:
        doc = tomllib.loads(text)
        project, out = doc.get("project", {}), []
        out += [(*_requirement(r), "runtime") for r in project.get("dependencies", [])]
        out += [(*_requirement(r), f"extra:{g}") for g, rs in project.get("optional-dependencies", {}).items() for r in rs]
        groups = doc.get("dependency-groups", {})

        def members(name: str, path: tuple[str, ...]) -> Iterator[str]:
            if name in path:
                raise ValueError(f"group cycle at {name}")
            for r in groups.get(name, []):
                if isinstance(r, str):
                    yield r
                elif "include-group" in r:
                    yield from members(r["include-group"], (*path, name))

        out += [(*_requirement(r), f"group:{g}") for g in groups for r in members(g, ())]
        tool = doc.get("tool", {})
        out += [(*_requirement(r), f"group:{g}") for g, rs in tool.get("pdm", {}).get("dev-dependencies", {}).items() for r in rs if not r.startswith("-e ")]
        out += [(*_requirement(r), "group:dev") for r in tool.get("uv", {}).get("dev-dependencies", [])]
        poetry = doc.get("tool", {}).get("poetry", {})
        tables = {"runtime": poetry.get("dependencies", {}), "group:dev": poetry.get("dev-dependencies", {})} | {f"group:{g}": t.get("dependencies", {}) for g, t in poetry.get("group", {}).items()}
        out += [(n, v if isinstance(v, str) else v.get("version", ""), None if isinstance(v, str) else v.get("markers"), g) for g, t in tables.items() for n, v in t.items() if n != "python" and isinstance(v, (str, dict))]
        return out

    return _rows(files, "display_name string, constraint_raw string, marker string, `group` string", ["display_name", "constraint_raw", "marker", "group"], read)


def toml_lock(files: DataFrame) -> DataFrame:
    """poetry.lock, pdm.lock, uv.lock and pylock.toml: ``(path, display_name, version, marker, problem)``, a row for each record."""

    def read(text: str) -> list[tuple]:
        doc = tomllib.loads(text)
        if "lock-version" in doc and doc["lock-version"] != "1.0":
            raise ValueError("unsupported lock-version")
        return [(p.get("name"), p.get("version"), p.get("marker") or (p.get("markers") if isinstance(p.get("markers"), str) else None)) for p in doc.get("packages", doc.get("package", []))]

    return _rows(files, "display_name string, version string, marker string", ["display_name", "version", "marker"], read)


def toml_lock_edges(files: DataFrame) -> DataFrame:
    """Requests within poetry, pdm and uv locks: ``(path, package, version, child, request, marker, problem)``; names are normalised."""
    from packaging.utils import canonicalize_name

    def read(text: str) -> list[tuple]:
        out = []
        for p in tomllib.loads(text).get("package", []):
            wants = p.get("dependencies", {})
            own = (str(canonicalize_name(p["name"])), p.get("version"))
            if isinstance(wants, dict):
                for name, d in wants.items():
                    d = d[0] if isinstance(d, list) and d else d
                    out.append((*own, str(canonicalize_name(name)), d if isinstance(d, str) else d.get("version", ""), None if isinstance(d, str) else d.get("markers")))
            for d in wants if isinstance(wants, list) else []:
                name, spec, marker = _requirement(d) if isinstance(d, str) else (d["name"], d.get("version", ""), d.get("marker"))
                out.append((*own, str(canonicalize_name(name)), spec, marker))
        return out

    names = ["package", "version", "child", "request", "marker"]
    return _rows(files, ", ".join(f"{n} string" for n in names), names, read)


def lock_hashes(files: DataFrame) -> DataFrame:
    """Artifact hashes of poetry, pdm, uv and pylock locks: ``(path, package, version, hash, problem)``."""

    def read(text: str) -> list[tuple]:
        doc = tomllib.loads(text)
        out = []
        for p in doc.get("packages", doc.get("package", [])):
            found = [f.get("hash") for f in p.get("files", [])] + [w.get("hash") for w in p.get("wheels", [])] + ([p["sdist"].get("hash")] if isinstance(p.get("sdist"), dict) else [])
            found += [f"{k}:{v}" for w in [*p.get("wheels", []), p.get("sdist") or {}] for k, v in (w.get("hashes") or {}).items()]
            out += [(p.get("name"), p.get("version"), h) for h in found if h]
        return out

    return _rows(files, "package string, version string, hash string", ["package", "version", "hash"], read)


def pipfile_lock(files: DataFrame) -> DataFrame:
    """Pipfile.lock: ``(path, package, version, category)``."""
    rows = files.select("path", F.explode(F.from_json("text", "map<string, map<string, struct<version:string, markers:string>>>")).alias("category", "m")).where("category <> '_meta'")
    return rows.select("path", "category", F.explode("m").alias("package", "p")).select("path", "package", F.regexp_replace("p.version", "^==", "").alias("version"), "category")


def pnpm_lock(files: DataFrame) -> DataFrame:
    """pnpm v9 locks: ``(path, source, alias, target, kind, problem)``: importer to snapshot and snapshot to snapshot edges, by key."""

    def read(text: str) -> list[tuple]:
        import yaml

        doc = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        if str(doc.get("lockfileVersion")) != "9.0":
            raise ValueError("unsupported lockfileVersion")
        out = []
        for at, sections in (doc.get("importers") or {}).items():
            for section in ("dependencies", "devDependencies", "optionalDependencies"):
                for name, d in (sections.get(section) or {}).items():
                    version = str(d["version"])
                    if not version.startswith(("link:", "file:")):
                        out.append((f"importer:{at}", name, version if "@" in version.split("(")[0].lstrip("@") else f"{name}@{version}", section))
        for key, s in (doc.get("snapshots") or {}).items():
            for section in ("dependencies", "optionalDependencies"):
                for name, version in ((s or {}).get(section) or {}).items():
                    version = str(version)
                    out.append((key, name, version if "@" in version.split("(")[0].lstrip("@") else f"{name}@{version}", section))
        return out

    return _rows(files, "source string, alias string, target string, kind string", ["source", "alias", "target", "kind"], read)


def problems(parsed: DataFrame, code: str) -> DataFrame:
    """``(code, path, message)`` of files that a helper couldn't read."""
    return parsed.where("problem is not null").select(F.lit(code).alias("code"), "path", F.col("problem").alias("message"))
