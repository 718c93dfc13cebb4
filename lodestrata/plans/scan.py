"""A whole scan: files to evidence relations to findings, as one set of DataFrames."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import source_scope
from lodestrata.lineage import cut, merged, written
from lodestrata.operators import evidence, graph
from lodestrata.operators.constraints import exact_pin, priority_lookup
from lodestrata.operators.lookup import longest_prefix, prefixes
from lodestrata.operators.selection import third_party
from lodestrata.sources import builds, manifests
from lodestrata.sources.files import folder
from lodestrata.sources.manifests import _rows

KEY = evidence.KEY


#: Top-level modules whose distribution has another name.
PYTHON_MODULES = {
    "bs4": "beautifulsoup4", "cv2": "opencv-python", "dateutil": "python-dateutil", "dotenv": "python-dotenv", "git": "gitpython", "jose": "python-jose", "jwt": "pyjwt", "mysqldb": "mysqlclient", "pil": "pillow",
    "sklearn": "scikit-learn", "yaml": "pyyaml",
}
#: What makes a folder a project of an ecosystem, and which files are its sources.
MANIFESTS = {"npm": r"^package\.json$", "pypi": r"^(pyproject\.toml|requirements[\w.-]*\.txt)$", "go": r"^go\.mod$", "cargo": r"^Cargo\.toml$"}
SOURCES = {"npm": r"\.(js|jsx|ts|tsx|mjs|cjs)$", "pypi": r"\.py$", "go": r"\.go$", "cargo": r"\.rs$"}
#: Kinds of files that a scan reads, by their endings; others aren't read.
KINDS = {"json": r"\.json$", "toml": r"\.toml$", "lock": r"\.lock$", "txt": r"\.(txt|in)$", "mod": r"\.mod$", **SOURCES}
_DECLARED = ["project_id", "ecosystem", "package", "scope", "kind", "constraint_raw", "constraint_scheme", "source_path", "go_kind"]


def _projects(files: DataFrame) -> DataFrame:
    """``(project_id, ecosystem)``: the folders with a manifest."""
    name = F.substring_index("path", "/", -1)
    found = F.array_compact(F.array(*[F.when(name.rlike(rule), F.lit(eco)) for eco, rule in MANIFESTS.items()]))
    return files.select(folder(F.col("path")).alias("project_id"), F.explode(found).alias("ecosystem")).distinct()


def _inclusions(files: DataFrame) -> DataFrame:
    """``manifests.include_closure`` of the requirements files that make projects; only files of their kind are read for it."""
    texts = files.where(F.col("path").rlike(r"\.(txt|in)$"))
    return manifests.include_closure(texts, texts.where(F.substring_index("path", "/", -1).rlike(MANIFESTS["pypi"])))


def _declarations(some: Callable[..., DataFrame], toml: DataFrame, cargo: DataFrame, inclusions: DataFrame) -> DataFrame:
    """What the manifests of all ecosystems declare; ``some`` gives files of kinds, ``toml`` and ``cargo`` are the parsed pyproject and Cargo files.

    A requirements file declares for its project what it includes too; constraint files declare nothing.
    """
    name = F.substring_index("path", "/", -1)

    def rows(df: DataFrame, eco: str, scheme: str, package, scope, kind=None, constraint="constraint_raw", go_kind=None, home=None) -> DataFrame:
        return df.select(
            (folder(F.col("path")) if home is None else home).alias("project_id"), F.lit(eco).alias("ecosystem"), package.alias("package"), scope.alias("scope"), (F.lit("direct") if kind is None else kind).alias("kind"),
            F.col(constraint).cast("string").alias("constraint_raw"), F.lit(scheme).alias("constraint_scheme"), F.col("path").alias("source_path"), F.lit(go_kind).cast("string").alias("go_kind"),
        )

    group = F.col("group")
    py_scope = F.when(group == "runtime", "runtime").when(group.startswith("extra:"), "optional").otherwise("development")
    # lines of each file once, by project: its own requirements files and what they include, a file of two roots once for each scope
    scope = F.when(F.substring_index("root", "/", -1).rlike(r"(?i)(dev|test)"), "development").otherwise("runtime")
    reached = inclusions.where("kind = 'requirement' and status = 'found'").select(folder(F.col("root")).alias("project_"), scope.alias("scope_"), "path").distinct()
    included = manifests.requirements(some("txt").join(reached.select("path").distinct(), "path", "left_semi")).join(reached, "path")
    return (
        rows(manifests.package_json(some("json").where(name == "package.json")), "npm", "semver", F.col("package"), F.col("scope"))
        .unionByName(rows(toml.where("problem is null"), "pypi", "pep440", manifests.pypi_name(F.col("display_name")), py_scope))
        .unionByName(rows(included, "pypi", "pep440", F.col("package"), F.col("scope_"), home=F.col("project_")))
        .unionByName(rows(manifests.go_mod(some("mod").where(name == "go.mod")), "go", "go", F.col("package"), F.lit("runtime"), F.when(F.col("indirect"), "transitive").otherwise("direct"), "version", "require"))
        .unionByName(rows(cargo.where("problem is null and package is not null"), "cargo", "cargo", F.col("package"), F.col("scope")))
    )


def _python_usages(uses: DataFrame, sources: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """Imports that neither the standard library nor the project's own modules answer, by distribution: configured, known, or inferred from the module's name."""
    parts = F.split("relative", "/")
    parts = F.when((parts[0] == "src") & (F.size(parts) > 1), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    local = sources.select("project_id", F.when(F.size(parts) > 1, parts[0]).otherwise(F.regexp_replace(parts[0], r"\.py$", "")).alias("module")).where("module <> '__init__'")
    rows = third_party(uses, local).withColumn("module", F.lower(F.substring_index("reference", ".", 1)))
    known = uses.sparkSession.createDataFrame(list(PYTHON_MODULES.items()), "module string, package string")
    tables = [("exact", known)] if mapping is None else [("configured", mapping.select(F.lower("reference").alias("module"), manifests.pypi_name(F.col("package")).alias("package"))), ("exact", known)]
    return priority_lookup(rows, "module", tables, manifests.pypi_name(F.col("module"))).drop("module")


def _go_usages(uses: DataFrame, declarations: DataFrame, files: DataFrame) -> DataFrame:
    """Imports by the longest required module that is a prefix; the standard library's and the module's own are left out, others are unknown."""
    own = files.where(F.substring_index("path", "/", -1) == "go.mod").select(folder(F.col("path")).alias("project_id"), F.regexp_extract("text", r"(?m)^\s*module\s+\"?([^\s\"]+)", 1).alias("own_"))
    rows = uses.where(F.substring_index("reference", "/", 1).contains(".")).join(own, "project_id", "left").where("own_ is null or not (reference = own_ or startswith(reference, concat(own_, '/')))").drop("own_")
    places = rows.select("project_id", "reference").distinct().withColumn("p", F.explode(prefixes(F.col("reference"))))
    known = declarations.where("ecosystem = 'go'").select("project_id", F.col("package").alias("p")).distinct()
    best = places.join(known, ["project_id", "p"]).groupBy("project_id", "reference").agg(F.max_by("p", F.length("p")).alias("package"))
    return rows.join(merged(best), ["project_id", "reference"], "left").withColumn("mapping_confidence", F.when(F.col("package").isNull(), "unknown").otherwise("exact"))


def _cargo_usages(uses: DataFrame, cargo: DataFrame, sources: DataFrame) -> DataFrame:
    """Crates by the name they are declared under (hyphens are underscores in sources); the project's own modules are left out, other names inferred."""
    plain = lambda c: F.replace(F.col(c), F.lit("-"), F.lit("_"))
    named = cargo.where("alias is not null").groupBy(folder(F.col("path")).alias("project_id"), plain("alias").alias("reference")).agg(F.min("package").alias("package"))
    local = sources.select("project_id", F.regexp_replace(F.element_at(F.split("relative", "/"), -1), r"\.rs$", "").alias("reference")).unionByName(sources.select("project_id", F.try_element_at(F.split("relative", "/"), F.lit(-2)).alias("reference"))).where("reference is not null").distinct()
    rows = uses.join(named, ["project_id", "reference"], "left")
    mine = local.join(named, ["project_id", "reference"], "left_anti")
    found = rows.join(merged(mine), ["project_id", "reference"], "left_anti")
    return found.withColumn("mapping_confidence", F.when(F.col("package").isNull(), "inferred").otherwise("exact")).withColumn("package", F.coalesce("package", "reference"))


def scan(files: DataFrame, mapping: DataFrame | None = None, projects: DataFrame | None = None) -> dict[str, DataFrame]:
    """Relations of ``files(path, text)``: projects, declarations, resolved, usages, capabilities, diagnostics, inclusions, findings.

    A project is a folder with a manifest of npm, PyPI, Go or Cargo (``MANIFESTS``). Sources belong to the nearest one of their
    ecosystem above them; a source's scope comes from its path within the project. Imports of the language's own library and of
    the project's own modules are no usages. ``mapping(reference, package)`` are configured names of Python modules; ``projects``
    is given where ``files`` is only a part of the tree (see ``incremental``). Requirements files are read with what they include. Locks
    give resolved versions, package.json's scripts usages of the declared tools they run. A file that can't be read gives a
    diagnostic and makes its project's evidence partial. Relations are joined by merges: by their packed files' size Spark would
    broadcast them at any number of rows.
    """
    kind = F.coalesce(*[F.when(F.col("path").rlike(rule), F.lit(k)) for k, rule in KINDS.items()])
    kept = merged(written(files.select("path", "text", kind.alias("kind")).where("kind is not null"), "kind"))  # read once, by kind: each relation below reads files of its own
    some = lambda *kinds: kept.where(F.col("kind").isin(*kinds)).select("path", "text")
    name = F.substring_index("path", "/", -1)
    projects = merged(cut(_projects(some("json", "toml", "txt", "mod"))) if projects is None else projects)  # relations that others are built from are written once, not parsed again for each
    kept_rows = lambda df: merged(cut(df))
    toml, cargo = kept_rows(manifests.pyproject(some("toml").where(name == "pyproject.toml"))), kept_rows(builds.cargo_toml(some("toml").where(name == "Cargo.toml")))
    inclusions = kept_rows(_inclusions(some("txt")))
    declarations = kept_rows(_declarations(some, toml, cargo, inclusions))
    resolved = (
        manifests.package_lock(some("json").where(name == "package-lock.json")).where("instance <> ''").select(folder(F.col("path")).alias("project_id"), F.lit("npm").alias("ecosystem"), "package", "version")
        .unionByName(manifests.toml_lock(some("toml", "lock").where(name.isin("poetry.lock", "pdm.lock", "uv.lock", "pylock.toml"))).where("problem is null").select(folder(F.col("path")).alias("project_id"), F.lit("pypi").alias("ecosystem"), manifests.pypi_name(F.col("display_name")).alias("package"), "version"))
        .unionByName(manifests.cargo_lock(some("lock").where(name == "Cargo.lock")).select(folder(F.col("path")).alias("project_id"), F.lit("cargo").alias("ecosystem"), "package", "version"))
    )
    kind = F.array_compact(F.array(*[F.when(name.rlike(rule), F.lit(eco)) for eco, rule in SOURCES.items()]))
    sources = some(*SOURCES).select("path", F.explode(kind).alias("ecosystem"), folder(F.col("path")).alias("folder"))
    owned = None
    for eco in SOURCES:
        roots = projects.where(F.col("ecosystem") == eco).select(F.col("project_id").alias("root"))
        own = longest_prefix(sources.where(F.col("ecosystem") == eco), "folder", roots, "root").where("root is not null")
        owned = own if owned is None else owned.unionByName(own)
    relative = F.when(F.col("root") == ".", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    owned = kept_rows(owned.select("path", "ecosystem", F.col("root").alias("project_id"), relative.alias("relative")).withColumn("scope", source_scope(F.col("ecosystem"), F.col("relative"))))
    imports = kept_rows(manifests.python_imports(some("pypi")))
    of = lambda loads, eco: loads.join(owned.where(F.col("ecosystem") == eco), "path")
    own = lambda eco: owned.where(F.col("ecosystem") == eco)
    regular = F.lit("regular").alias("kind")
    js = of(manifests.js_loads(some("npm")).select("path", "reference", "kind"), "npm").withColumn("package", manifests.npm_package()).where("package is not null").withColumn("mapping_confidence", F.lit("exact"))
    py = _python_usages(of(imports.where("problem is null").select("path", "reference", "kind"), "pypi"), own("pypi"), mapping)
    go = _go_usages(of(builds.go_imports(some("go")).select("path", "reference", regular), "go"), declarations, some("mod"))
    rust = _cargo_usages(of(builds.rust_references(some("cargo")).select("path", "reference", regular), "cargo"), cargo, own("cargo"))
    columns = ["project_id", "ecosystem", "reference", "package", "scope", "kind", "mapping_confidence", F.col("path").alias("source_path")]
    tools = builds.script_commands(some("json").where(name == "package.json")).where("supported").select(folder(F.col("path")).alias("project_id"), F.lit("npm").alias("ecosystem"), F.col("executable").alias("reference"), F.col("executable").alias("package"), F.lit("build").alias("scope"), F.lit("command").alias("kind"), F.lit("exact").alias("mapping_confidence"), F.col("path").alias("source_path"))
    tools = tools.join(declarations.where("scope <> 'build'").select(KEY), KEY, "left_semi").select("project_id", "ecosystem", "reference", "package", "scope", "kind", "mapping_confidence", "source_path")
    rows = js.select(columns).unionByName(py.select(columns)).unionByName(go.select(columns)).unionByName(rust.select(columns)).unionByName(tools)
    usages = kept_rows(rows.withColumn("kind", F.when(F.col("kind").isin("optional", "command"), F.col("kind")).otherwise("regular")))
    lost = inclusions.where("status <> 'found' or (endless and path = root)").select(F.when(F.col("status") == "found", "manifest.include-cycle").otherwise(F.concat(F.lit("manifest.include-"), "status")).alias("code"), F.col("root").alias("path"), F.col("path").alias("message"))
    bad = lost.unionByName(manifests.problems(toml, "manifest.unreadable")).unionByName(manifests.problems(cargo, "manifest.unreadable")).unionByName(manifests.problems(imports, "usage.unreadable"))
    roots = projects.select(F.col("project_id").alias("root")).distinct()
    diagnostics = longest_prefix(bad.withColumn("folder", folder(F.col("path"))), "folder", roots, "root").select(F.col("root").alias("project_id"), "code", F.lit("error").alias("severity"), "path", "message")
    failed = diagnostics.select("project_id", F.when(F.col("code").startswith("manifest."), "manifest").otherwise("usage").alias("name")).distinct().withColumn("failed", F.lit(True))
    wanted = projects.select("project_id", F.explode(F.array(F.lit("manifest"), F.lit("usage"))).alias("name")).distinct()
    capabilities = wanted.join(failed, ["project_id", "name"], "left").select("project_id", "name", F.when(F.col("failed"), "partial").otherwise("complete").alias("state"))
    found = evidence.findings(declarations, usages, resolved, capabilities, exact_pin(F.col("constraint_scheme"), F.col("constraint_raw")))
    return {"projects": projects, "declarations": declarations, "resolved": resolved, "usages": usages, "capabilities": capabilities, "diagnostics": diagnostics, "inclusions": inclusions, "findings": found}


def canonical_rows(relations: dict[str, DataFrame]) -> DataFrame:
    """``(relation, row)`` of a scan: each row as JSON with sorted keys, nulls kept; written as lines, no relation is gathered."""
    out = None
    for name, df in relations.items():
        own = df.select(F.lit(name).alias("relation"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("row"))
        out = own if out is None else out.unionByName(own)
    return out


def export_problems(relations: dict[str, DataFrame]) -> DataFrame:
    """``(check, n)`` of a scan that isn't fit for export: rows of unknown projects, keys without a package, findings without a key in the evidence."""
    projects = relations["projects"].select("project_id").distinct()
    out = None
    for name in ("declarations", "resolved", "usages", "findings"):
        df = relations[name]
        own = df.join(projects, "project_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"{name}.unknown-project").alias("check"), "n")
        blank = df.where("package is null or package = ''").agg(F.count("*").alias("n")).select(F.lit(f"{name}.no-package").alias("check"), "n")
        out = own.unionByName(blank) if out is None else out.unionByName(own).unionByName(blank)
    keys = relations["declarations"].select(KEY).unionByName(relations["usages"].select(KEY)).distinct()
    lost = relations["findings"].join(keys, KEY, "left_anti").agg(F.count("*").alias("n")).select(F.lit("findings.no-evidence").alias("check"), "n")
    return out.unionByName(lost).where("n > 0")


#: Nodes of Python's syntax that hold no call, and the lists of a statement that hold statements, in the order of its fields.
_LEAVES = frozenset([ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.alias, ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal, ast.Pass, ast.Break, ast.Continue])
_BODIES = ("body", "handlers", "orelse", "finalbody", "cases")


def _statements(module: ast.Module) -> list[ast.AST]:
    """The statements of a module in the order of ``ast.walk``, which visits expressions too."""
    out: list[ast.AST] = [module]
    for node in out:
        for name in _BODIES:
            out += getattr(node, name, ())
    return out


def python_calls(files: DataFrame) -> DataFrame:
    """Calls between functions of Python sources: ``(path, caller, callee, problem)``; names are ``module.function`` by the file's path.

    A bare name is a function of the file or an imported one; ``self.f`` is a method of the class at hand; what isn't known is left out.
    """

    def read(text: str) -> list[tuple]:
        module = ast.parse(text)
        statements = _statements(module)
        names = {a.asname or a.name: f"{n.module}.{a.name}" for n in statements if isinstance(n, ast.ImportFrom) and n.module and not n.level for a in n.names}
        names |= {a.asname or a.name: a.name for n in statements if isinstance(n, ast.Import) for a in n.names}
        tops = {n.name for n in module.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)}
        out: set[tuple] = set()

        def walk(node: ast.AST, inside: str, owner: str | None) -> None:
            for child in ast.iter_child_nodes(node):
                if type(child) in _LEAVES:
                    continue
                if isinstance(child, ast.ClassDef):
                    walk(child, inside, child.name)
                elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                    walk(child, inside if inside else f"{owner}.{child.name}" if owner else child.name, owner)
                else:
                    if isinstance(child, ast.Call) and inside:
                        f = child.func
                        if isinstance(f, ast.Name) and (f.id in tops or f.id in names):
                            out.add((f".{inside}", f".{f.id}" if f.id in tops else names[f.id]))
                        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "self" and owner:
                            out.add((f".{inside}", f".{owner}.{f.attr}"))
                        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in names:
                            out.add((f".{inside}", f"{names[f.value.id]}.{f.attr}"))
                    walk(child, inside, owner)

        walk(module, "", None)
        return sorted(out)

    rows = _rows(files, "caller string, callee string", ["caller", "callee"], read)
    module = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    full = lambda c: F.when(F.col(c).startswith("."), F.concat(module, F.col(c))).otherwise(F.col(c))
    return rows.select("path", full("caller").alias("caller"), full("callee").alias("callee"), "problem")


def callable_from(calls: DataFrame, entries: DataFrame, rounds: int = 64) -> tuple[DataFrame, bool]:
    """Which of ``entries(entry)`` may call what: ``(node, fact)`` by carrying entries along ``calls(caller, callee)``, and whether that ended in time."""
    return graph.fixpoint(calls.select(F.col("caller").alias("source"), F.col("callee").alias("target")), entries.select(F.col("entry").alias("node"), F.col("entry").alias("fact")), rounds)
