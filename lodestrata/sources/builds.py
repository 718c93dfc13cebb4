"""Further manifests, build files and sources to evidence rows, in the manner of ``manifests``."""

from __future__ import annotations

import ast
import configparser
import tomllib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import pypi_name
from lodestrata.lineage import written

from . import lexer
from .files import numbered_lines
from .manifests import _requirement, _rows


def _strip(files: DataFrame, block: str | None, line: str) -> DataFrame:
    """Files without comments; newlines of block comments stay, so that line numbers do."""
    text = F.regexp_replace("text", line, "")
    if block:
        text = F.regexp_replace(text, block, "")
    return files.withColumn("text", text)


def gradle_dependencies(files: DataFrame) -> DataFrame:
    """build.gradle and build.gradle.kts literal coordinates: ``(path, line, package, constraint_raw, configuration, scope, kind, literal, context)``; nothing is evaluated (see ``lexer.gradle_calls``)."""
    names = ["line", "package", "constraint_raw", "configuration", "scope", "kind", "literal", "context"]
    rows = _rows(files, "line int, " + ", ".join(f"{n} string" for n in names[1:]), names, lexer.gradle_calls)
    return rows.where("problem is null").withColumn("literal", F.col("literal").cast("boolean")).drop("problem")


def version_catalog(files: DataFrame) -> DataFrame:
    """Gradle version catalogs: ``(path, alias, package, constraint_raw, problem)``; aliases are normalised, version references resolved."""

    def read(text: str) -> list[tuple]:
        doc = tomllib.loads(text)
        versions, out = doc.get("versions", {}), []
        for alias, lib in doc.get("libraries", {}).items():
            if isinstance(lib, str):
                group, name, *rest = lib.split(":")
                version = rest[0] if rest else None
            else:
                group, name = lib["module"].split(":") if "module" in lib else (lib["group"], lib["name"])
                v = lib.get("version")
                version = versions.get(v["ref"]) if isinstance(v, dict) and "ref" in v else v
            if isinstance(version, dict):
                version = version.get("strictly") or version.get("require") or version.get("prefer")
            out.append((alias.replace("-", ".").replace("_", "."), f"{group}:{name}", version))
        return out

    return _rows(files, "alias string, package string, constraint_raw string", ["alias", "package", "constraint_raw"], read)


def cargo_toml(files: DataFrame) -> DataFrame:
    """Cargo.toml: ``(path, package, alias, constraint_raw, scope, inherited, problem)``; ``workspace = true`` is marked as inherited."""

    def read(text: str) -> list[tuple]:
        doc, out = tomllib.loads(text), []
        tables = [(doc, "runtime")] + [(t, "conditional") for t in doc.get("target", {}).values()]
        for table, kind in tables:
            for section, scope in (("dependencies", "runtime"), ("dev-dependencies", "test"), ("build-dependencies", "build")):
                for name, d in table.get(section, {}).items():
                    d = {"version": d} if isinstance(d, str) else d
                    out.append((d.get("package", name), name, d.get("version"), "optional" if d.get("optional") else scope, str(bool(d.get("workspace"))).lower()))
        return out

    return _rows(files, "package string, alias string, constraint_raw string, scope string, inherited string", ["package", "alias", "constraint_raw", "scope", "inherited"], read)


def inherit_workspace(declarations: DataFrame, workspace: DataFrame) -> DataFrame:
    """Cargo declarations with the constraint of their workspace's table ``(workspace, alias, constraint_raw)`` filled in where inherited."""
    own = workspace.select("workspace", "alias", F.col("constraint_raw").alias("w"))
    return declarations.join(own, ["workspace", "alias"], "left").withColumn("constraint_raw", F.when(F.col("inherited") == "true", F.col("w")).otherwise(F.col("constraint_raw"))).drop("w")


def pipfile(files: DataFrame) -> DataFrame:
    """Pipfile: ``(path, display_name, constraint_raw, group, problem)``."""

    def read(text: str) -> list[tuple]:
        doc = tomllib.loads(text)
        groups = {"packages": "runtime", "dev-packages": "development"}
        return [(n, v if isinstance(v, str) else v.get("version", "*"), groups.get(t, f"pipenv:{t}")) for t, rows in doc.items() if t not in ("source", "requires", "scripts", "pipenv") and isinstance(rows, dict) for n, v in rows.items() if isinstance(v, (str, dict))]

    return _rows(files, "display_name string, constraint_raw string, `group` string", ["display_name", "constraint_raw", "group"], read)


def _ini(text: str) -> dict[str, dict[str, str]]:
    """Sections of an INI text and their options, defaults before a section's own, as ``configparser.RawConfigParser`` reads them, at a fraction of
    its cost for a small file. What isn't told here is given to it, mostly for its error."""
    defaults: dict[str, list[str]] = {}
    sections: dict[str, dict[str, list[str]]] = {}
    here = value = None
    depth = 0
    for line in text.split("\n"):
        clean = line.strip()
        if not clean:
            if value is not None:
                value.append("")
            continue
        if clean[0] in "#;":
            continue
        indent = len(line) - len(line.lstrip())
        if value is not None and indent > depth:
            value.append(clean)
            continue
        depth = indent
        if clean[0] == "[" and (end := clean.rfind("]")) > 1:
            name, value = clean[1:end], None
            if name in sections:
                break
            here = defaults if name == "DEFAULT" else sections.setdefault(name, {})
            continue
        places = [i for i in (clean.find("="), clean.find(":")) if i >= 0]
        name = clean[: min(places)].rstrip().lower() if places else ""
        if here is None or not name or name in here:
            break
        here[name] = value = [clean[min(places) + 1 :].strip()]
    else:
        told = lambda options: {k: "\n".join(v).rstrip() for k, v in options.items()}
        first = told(defaults)
        return {k: first | told(v) for k, v in sections.items()}
    c = configparser.RawConfigParser()
    try:
        c.read_string(text)
    except configparser.Error as e:
        raise ValueError(str(e)) from e
    return {k: dict(c.items(k)) for k in c.sections()}


def setup_cfg(files: DataFrame) -> DataFrame:
    """setup.cfg: ``(path, display_name, constraint_raw, marker, group, problem)``; values are read without interpolation."""

    def read(text: str) -> list[tuple]:
        c = _ini(text)
        out = [(*_requirement(r), "runtime") for r in c.get("options", {}).get("install_requires", "").split("\n") if r.strip()]
        return out + [(*_requirement(r), f"extra:{k}") for k, v in c.get("options.extras_require", {}).items() for r in v.split("\n") if r.strip()]

    return _rows(files, "display_name string, constraint_raw string, marker string, `group` string", ["display_name", "constraint_raw", "marker", "group"], read)


def script_metadata(files: DataFrame) -> DataFrame:
    """PEP 723 blocks of scripts: ``(path, display_name, constraint_raw, marker, problem)``."""

    def read(text: str) -> list[tuple]:
        lines, block, inside = text.split("\n"), [], False
        for line in lines:
            if line == "# /// script":
                inside = True
            elif inside and line == "# ///":
                break
            elif inside and line.startswith("#"):
                block.append(line[2:])
            elif inside:
                raise ValueError("unclosed script block")
        return [_requirement(r) for r in tomllib.loads("\n".join(block)).get("dependencies", [])]

    return _rows(files, "display_name string, constraint_raw string, marker string", ["display_name", "constraint_raw", "marker"], read)


def pip_commands(files: DataFrame) -> DataFrame:
    """``pip install`` hints of Dockerfiles, Makefiles and the like: ``(path, line, package, constraint_raw)``; options and paths are left out."""
    rows = numbered_lines(files.withColumn("text", F.regexp_replace("text", r"\\\n", " "))).where(F.col("text").rlike(r"\bpip3?\s+install\b"))
    word = rows.select("path", "line", F.explode(F.split(F.regexp_extract("text", r"\bpip3?\s+install\s+([^&|;]*)", 1), r"\s+")).alias("w"))
    word = word.withColumn("w", F.regexp_replace("w", r"['\"]", "")).where(F.col("w").rlike(r"^[A-Za-z0-9][A-Za-z0-9._\-]*(\[[^\]]*\])?([=<>!~]=?.*)?$") & ~F.col("w").rlike(r"\.(txt|whl|gz|zip)$"))
    return word.select("path", "line", pypi_name(F.regexp_extract("w", r"^([A-Za-z0-9._\-]+)", 1)).alias("package"), F.regexp_extract("w", r"([=<>!~].*)$", 1).alias("constraint_raw"))


def yarn_lock(files: DataFrame) -> DataFrame:
    """Yarn Modern locks: ``(path, descriptor, package, version)``, a row for each comma-separated descriptor."""
    blocks = files.where(F.col("text").contains("__metadata:")).select("path", F.explode(F.regexp_extract_all("text", F.lit(r'(?ms)^("?[^\s#][^\n]*:\n(?:[ \t]+[^\n]*\n?)+)'), F.lit(1))).alias("b"))
    head = F.regexp_replace(F.regexp_extract("b", r'^"?([^\n]*?)"?:\n', 1), '"', "")
    rows = blocks.select("path", F.explode(F.split(head, r",\s*")).alias("descriptor"), F.regexp_extract("b", r'(?m)^\s+version:\s*"?([^"\n]+)"?', 1).alias("version")).where("descriptor <> '__metadata'")
    return rows.select("path", "descriptor", F.regexp_extract("descriptor", r"^(@?[^@]+)@", 1).alias("package"), "version").where("package <> ''")


def go_imports(files: DataFrame) -> DataFrame:
    """Imports of Go files: ``(path, reference)``, of blocks and single lines."""
    bare = _strip(files, r"(?s)/\*.*?\*/", r"(?m)//.*$")
    block = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"(?s)\bimport\s*\((.*?)\)"), F.lit(1)), lambda b: F.regexp_extract_all(b, F.lit('"([^"]+)"'), F.lit(1))))
    single = F.regexp_extract_all("text", F.lit(r'(?m)^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"'), F.lit(1))
    return bare.select("path", F.explode(F.concat(block, single)).alias("reference"))


def css_imports(files: DataFrame) -> DataFrame:
    """Literal ``@import`` of style sheets: ``(path, reference)``."""
    return _strip(files, r"(?s)/\*.*?\*/", r"(?!)").select("path", F.explode(F.regexp_extract_all("text", F.lit(r"""@import\s+(?:url\(\s*)?['"]([^'"]+)['"]"""), F.lit(1))).alias("reference"))


def component_scripts(files: DataFrame) -> DataFrame:
    """``(path, text)``: the scripts of Vue, Svelte and Astro components, for ``manifests.js_loads``."""
    tags = F.regexp_extract_all("text", F.lit(r"(?s)<script\b[^>]*>(.*?)</script>"), F.lit(1))
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1)
    return files.select("path", F.array_join(F.concat(tags, F.array(front)), "\n").alias("text"))


def rust_references(files: DataFrame) -> DataFrame:
    """Crates that Rust sources name: ``(path, line, reference)``; own and standard crates are left out."""
    rows = numbered_lines(_strip(files, r"(?s)/\*.*?\*/", r"(?m)//.*$"))
    hits = F.concat(F.regexp_extract_all("text", F.lit(r"^\s*(?:pub\s+)?use\s+(?:::)?([a-z_]\w*)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"^\s*extern\s+crate\s+(\w+)"), F.lit(1)))
    return rows.select("path", "line", F.explode(hits).alias("reference")).where(~F.col("reference").isin("std", "core", "alloc", "crate", "self", "super"))


def conanfile(files: DataFrame) -> DataFrame:
    """conanfile.txt and conanfile.py literals: ``(path, package, constraint_raw, scope)``."""
    section = lambda name: F.regexp_extract("text", rf"(?ms)^\[{name}\]\s*\n(.*?)(?=^\[|\z)", 1)
    ref = r"([a-z0-9_][\w+.\-]+)/([^@#\s\"']+)"
    pieces = F.array(F.struct(F.lit("runtime").alias("scope"), section("requires").alias("t")), F.struct(F.lit("build").alias("scope"), F.concat(section("tool_requires"), section("build_requires")).alias("t")), F.struct(F.lit("test").alias("scope"), section("test_requires").alias("t")))
    txt = files.select("path", F.explode(pieces).alias("p")).select("path", "p.scope", F.explode(F.regexp_extract_all("p.t", F.lit(rf"(?m)^\s*{ref}"), F.lit(0))).alias("r"))
    calls = {"runtime": r"self\.requires", "build": r"self\.(?:tool_requires|build_requires)", "test": r"self\.test_requires"}
    py = None
    for scope, name in calls.items():
        own = files.select("path", F.lit(scope).alias("scope"), F.explode(F.regexp_extract_all("text", F.lit(rf"""{name}\(\s*["']({ref})"""), F.lit(1))).alias("r"))
        py = own if py is None else py.union(own)
    return txt.union(py).select("path", F.regexp_extract("r", ref, 1).alias("package"), F.regexp_extract("r", ref, 2).alias("constraint_raw"), "scope")


def cmake_commands(files: DataFrame) -> DataFrame:
    """CMake's literal package commands: ``(path, line, package, version, kind, required, components, conditional)`` (see ``lexer.cmake_calls``)."""
    names = ["line", "package", "version", "kind", "required", "components", "conditional"]
    rows = _rows(files, "line int, " + ", ".join(f"{n} string" for n in names[1:]), names, lexer.cmake_calls)
    return rows.where("problem is null").withColumn("required", F.col("required").cast("boolean")).withColumn("conditional", F.col("conditional").cast("boolean")).drop("problem")


def bazel_deps(files: DataFrame) -> DataFrame:
    """``bazel_dep`` calls of MODULE.bazel: ``(path, package, version, dev)``; only literal arguments count."""
    rows = _strip(files, None, r"(?m)#.*$").select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)\bbazel_dep\s*\((.*?)\)"), F.lit(1))).alias("c"))
    arg = lambda k: F.nullif(F.regexp_extract("c", rf'\b{k}\s*=\s*"([^"]*)"', 1), F.lit(""))
    return rows.select("path", arg("name").alias("package"), arg("version").alias("version"), F.col("c").rlike(r"\bdev_dependency\s*=\s*True").alias("dev")).where("package is not null")


def script_commands(files: DataFrame) -> DataFrame:
    """Commands of package.json scripts: ``(path, script, executable, supported)``; operators, expansions and ``cd`` aren't interpreted."""
    rows = files.select("path", F.explode(F.from_json("text", "scripts map<string,string>")["scripts"]).alias("script", "command"))
    bare = F.regexp_replace(F.trim("command"), r"^(?:[A-Za-z_]\w*=\S+\s+)*(?:npx\s+)?", "")
    return rows.select("path", "script", F.regexp_extract(bare, r"^(\S+)", 1).alias("executable"), (~F.col("command").rlike(r"[|&;<>`$(){}]") & ~bare.rlike(r"^cd\b")).alias("supported"))


def workflow_commands(files: DataFrame) -> DataFrame:
    """``run`` steps of GitHub workflows: ``(path, job, command, problem)``, a row for each line of single-line and block ones."""

    def read(text: str) -> list[tuple]:
        import yaml

        doc = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}
        return [(job, line.strip()) for job, j in (doc.get("jobs") or {}).items() for step in j.get("steps") or [] for line in str(step.get("run") or "").split("\n") if line.strip()]

    return _rows(files, "job string, command string", ["job", "command"], read)


def tsconfig_types(files: DataFrame) -> DataFrame:
    """``types`` of tsconfig files as packages: ``(path, package)``; names without a scope stand for ``@types/…``."""
    rows = files.select("path", F.explode(F.from_json(F.regexp_replace("text", r"(?m)^\s*//.*$", ""), "compilerOptions struct<types:array<string>>")["compilerOptions"]["types"]).alias("t")).where(~F.col("t").startswith("."))
    return rows.select("path", F.when(F.col("t").startswith("@"), F.regexp_extract("t", "^(@[^/]+/[^/]+)", 1)).otherwise(F.concat(F.lit("@types/"), F.substring_index("t", "/", 1))).alias("package"))


def setup_py(files: DataFrame) -> DataFrame:
    """Literal arguments of ``setup()`` in setup.py: ``(path, display_name, constraint_raw, marker, group, problem)``; nothing is run.

    Names bound once to a literal at the top of the file count as that literal; anything else gives ``problem``.
    """

    def read(text: str) -> list[tuple]:
        module = ast.parse(text)
        named: dict[str, object] = {}
        for node in module.body:
            if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
                try:
                    named[node.targets[0].id] = ast.literal_eval(node.value)
                except ValueError:
                    named.pop(node.targets[0].id, None)

        def literal(node: ast.expr) -> object:
            return named[node.id] if isinstance(node, ast.Name) and node.id in named else ast.literal_eval(node)

        out: list[tuple] = []
        for call in ast.walk(module):
            if isinstance(call, ast.Call) and getattr(call.func, "attr", getattr(call.func, "id", "")) == "setup":
                for word in call.keywords:
                    if word.arg in ("install_requires", "tests_require", "setup_requires"):
                        found = literal(word.value)
                        group = {"install_requires": "runtime", "tests_require": "test", "setup_requires": "build"}[word.arg]
                        out += [(*_requirement(r), group) for r in (found.split("\n") if isinstance(found, str) else found) if r.strip()]
                    elif word.arg == "extras_require":
                        out += [(*_requirement(r), f"extra:{g}") for g, rs in literal(word.value).items() for r in ([rs] if isinstance(rs, str) else rs)]
        return out

    return _rows(files, "display_name string, constraint_raw string, marker string, `group` string", ["display_name", "constraint_raw", "marker", "group"], read)


def python_tasks(files: DataFrame) -> DataFrame:
    """Hatch scripts and Poe tasks of pyproject.toml: ``(path, tool, task, command, problem)``; a sequence gives a row for each command."""

    def read(text: str) -> list[tuple]:
        tool, out = tomllib.loads(text).get("tool", {}), []
        for env, table in tool.get("hatch", {}).get("envs", {}).items():
            for name, command in table.get("scripts", {}).items():
                out += [("hatch", f"{env}:{name}", c) for c in ([command] if isinstance(command, str) else command) if isinstance(c, str)]
        for name, task in tool.get("poe", {}).get("tasks", {}).items():
            parts = task if isinstance(task, list) else task.get("sequence", [task]) if isinstance(task, dict) else [task]
            for part in parts:
                command = part if isinstance(part, str) else part.get("cmd") or part.get("shell") if isinstance(part, dict) else None
                if isinstance(command, str):
                    out.append(("poe", name, command))
        return out

    return _rows(files, "tool string, task string, command string", ["tool", "task", "command"], read)


def uv_sources(files: DataFrame) -> DataFrame:
    """uv's package sources and indexes in pyproject.toml: ``(path, fact, name, kind, location, problem)``.

    ``fact`` is ``source`` (a package and where it must come from) or ``index`` (its kind: default, explicit or extra).
    """

    def read(text: str) -> list[tuple]:
        uv, out = tomllib.loads(text).get("tool", {}).get("uv", {}), []
        for i in uv.get("index", []):
            out.append(("index", i.get("name", ""), "default" if i.get("default") else "explicit" if i.get("explicit") else "extra", i.get("url", "")))
        for name, source in uv.get("sources", {}).items():
            for one in source if isinstance(source, list) else [source]:
                kinds = [k for k in ("index", "git", "url", "path", "workspace") if k in one]
                out.append(("source", pep503(name), kinds[0] if len(kinds) == 1 else "unknown", str(one[kinds[0]]) if len(kinds) == 1 else ""))
        return out

    def pep503(name: str) -> str:
        return "-".join(x for x in name.lower().replace("_", "-").replace(".", "-").split("-") if x)

    return _rows(files, "fact string, name string, kind string, location string", ["fact", "name", "kind", "location"], read)


def uv_origins(packages: DataFrame, facts: DataFrame) -> DataFrame:
    """``packages(path, package)`` with the ``origin`` that ``uv_sources`` gives them: their own source, else the file's default index, else the public one.

    Facts are read once for the three joins, which are merges: an estimate by the size of the table behind the files would broadcast facts of any number.
    """
    facts = written(facts)
    own = facts.where("fact = 'source'").select("path", F.col("name").alias("package"), "kind", "location")
    named = facts.where("fact = 'index'").select("path", F.col("name").alias("location"), F.col("location").alias("address"))
    default = facts.where("fact = 'index' and kind = 'default'").groupBy("path").agg(F.min("location").alias("default"))
    rows = packages.join(own.hint("merge"), ["path", "package"], "left").join(named.hint("merge"), ["path", "location"], "left").join(default.hint("merge"), "path", "left")
    return rows.select(*packages.columns, F.when(F.col("kind") == "index", F.coalesce("address", F.lit("unknown"))).when(F.col("kind").isNotNull(), F.col("location")).otherwise(F.coalesce("default", F.lit("https://pypi.org/simple"))).alias("origin"))


def conan_lock(files: DataFrame) -> DataFrame:
    """conan.lock (2.x): ``(path, package, version, revision, scope)`` of ``requires``, ``build_requires`` and ``python_requires``."""
    kinds = {"requires": "runtime", "build_requires": "build", "python_requires": "build"}
    parsed = files.select("path", F.from_json("text", ", ".join(f"{k} array<string>" for k in kinds)).alias("j"))
    out = None
    for kind, scope in kinds.items():
        own = parsed.select("path", F.explode(f"j.{kind}").alias("r"), F.lit(scope).alias("scope"))
        out = own if out is None else out.union(own)
    rule = r"^([^/#%]+)/([^@#%]+)(?:@[^#%]*)?(?:#([^%]+))?"
    return out.select("path", F.regexp_extract("r", rule, 1).alias("package"), F.regexp_extract("r", rule, 2).alias("version"), F.nullif(F.regexp_extract("r", rule, 3), F.lit("")).alias("revision"), "scope").where("package <> ''")


def vcpkg_pins(files: DataFrame) -> DataFrame:
    """vcpkg.json ``overrides`` and lock baselines: ``(path, package, version, kind)``; an override pins, ``builtin-baseline`` names the registry's state."""
    over = files.select("path", F.explode(F.from_json("text", "overrides array<struct<name:string, version:string, `version-string`:string, `version-semver`:string, `port-version`:int>>")["overrides"]).alias("o"))
    version = F.concat(F.coalesce("o.version", F.col("o.version-string"), F.col("o.version-semver")), F.coalesce(F.concat(F.lit("#"), F.col("o.port-version").cast("string")), F.lit("")))
    pins = over.select("path", F.col("o.name").alias("package"), version.alias("version"), F.lit("override").alias("kind"))
    base = files.select("path", F.lit(None).cast("string").alias("package"), F.get_json_object("text", "$.builtin-baseline").alias("version"), F.lit("baseline").alias("kind")).where("version is not null")
    return pins.union(base)


def cargo_overrides(files: DataFrame) -> DataFrame:
    """Cargo ``[patch]`` and ``[replace]`` tables: ``(path, kind, registry, package, version, location, problem)``; they qualify evidence, nothing is applied."""

    def read(text: str) -> list[tuple]:
        doc, out = tomllib.loads(text), []
        for registry, table in doc.get("patch", {}).items():
            for name, d in table.items():
                d = {"version": d} if isinstance(d, str) else d
                out.append(("patch", registry, d.get("package", name), d.get("version"), d.get("git") or d.get("path")))
        for spec, d in doc.get("replace", {}).items():
            name, _, version = spec.rpartition("#")[2].partition(":")
            out.append(("replace", None, name, version or None, d.get("git") or d.get("path")))
        return out

    names = ["kind", "registry", "package", "version", "location"]
    return _rows(files, ", ".join(f"{n} string" for n in names), names, read)


def pytest_plugins(files: DataFrame) -> DataFrame:
    """pytest plugins that configuration names: ``(path, module, problem)`` from ``-p`` of ``addopts`` in pytest.ini, setup.cfg, tox.ini and pyproject.toml, and ``required_plugins``."""

    def read(text: str) -> list[tuple]:
        options: list[str] = []
        required: list[str] = []
        try:
            own = tomllib.loads(text).get("tool", {}).get("pytest", {}).get("ini_options", {})
            found = own.get("addopts", "")
            options += found.split() if isinstance(found, str) else found
            wanted = own.get("required_plugins", "")
            required += wanted.split() if isinstance(wanted, str) else wanted
        except tomllib.TOMLDecodeError:
            c = _ini(text)
            for section in ("pytest", "tool:pytest"):
                options += c.get(section, {}).get("addopts", "").split()
                required += c.get(section, {}).get("required_plugins", "").split()
        out = [options[i + 1] if o == "-p" and i + 1 < len(options) else o[2:] for i, o in enumerate(options) if o == "-p" or o.startswith("-p") and not o.startswith("--")]
        return [(m,) for m in sorted({*(x for x in out if x and not x.startswith("no:")), *(r.split("=")[0].split(">")[0].split("<")[0] for r in required)})]

    return _rows(files, "module string", ["module"], read)


def fan_in(declarations: dict[str, DataFrame]) -> DataFrame:
    """Declarations of several manifest kinds as one relation ``(manifest, path, package, constraint_raw, marker, group, occurrence)``.

    Equal declarations of one file are numbered, so that repeated ones keep their multiplicity.
    """
    out = None
    for manifest, df in declarations.items():
        group = F.col("group") if "group" in df.columns else F.lit("runtime")
        rows = df.select(F.lit(manifest).alias("manifest"), "path", pypi_name(F.col("display_name")).alias("package"), "constraint_raw", "marker", group.alias("group"))
        out = rows if out is None else out.unionByName(rows)
    same = ["manifest", "path", "package", "constraint_raw", "marker", "group"]
    counted = out.where("package is not null").groupBy(same).agg(F.count("*").alias("n"))
    return counted.select(*same, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("occurrence"))
