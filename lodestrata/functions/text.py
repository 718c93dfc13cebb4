"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def redact(text: Column) -> Column:
    """Credentials in URLs and values of secret-named keys become ``***``."""
    url = F.regexp_replace(text, r"(https?://)[^/\s:@]+:[^/\s@]+@", "$1***@")
    return F.regexp_replace(url, r"(?i)\b(token|password|secret|api_key)(\s*[=:]\s*)[^\s,;]+", "$1$2***")


def literal_references(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def pypi_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def purl(kind: Column, name: Column, version: Column | None = None, namespace: Column | None = None) -> Column:
    """A package URL; null parts are left out."""
    part = lambda c: F.regexp_replace(F.url_encode(c), r"\+", "%20")
    out = [F.lit("pkg:"), F.lower(kind), F.lit("/")]
    if namespace is not None:
        out.append(F.coalesce(F.concat(F.array_join(F.transform(F.split(namespace, "/"), part), "/"), F.lit("/")), F.lit("")))
    out.append(part(name))
    if version is not None:
        out.append(F.coalesce(F.concat(F.lit("@"), part(version)), F.lit("")))
    return F.concat(*out)


def parse_purl(text: Column) -> Column:
    """A struct (type, namespace, name, version, qualifiers, subpath) of a package URL; null if it is none."""
    bare = F.regexp_extract(text, r"^pkg:/*([^?#]*)", 1)
    path = F.regexp_replace(bare, r"@[^@/]*$", "")
    parts = F.split(path, "/")
    decode = lambda c: F.try_url_decode(F.regexp_replace(c, r"\+", "%2B"))
    blank = lambda c: F.when(c != "", c)
    ok = text.rlike(r"^pkg:/*[A-Za-z][A-Za-z0-9.+-]*/[^?#]*[^/?#@]")
    return F.when(ok, F.struct(
        F.lower(parts[0]).alias("type"), blank(F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), decode), "/")).alias("namespace"), decode(F.element_at(parts, -1)).alias("name"),
        blank(decode(F.regexp_extract(bare, r"@([^@/]*)$", 1))).alias("version"), F.expr("null").cast("string").alias("unused"), blank(F.regexp_extract(text, r"\?([^#]*)", 1)).alias("qualifiers"), blank(F.regexp_extract(text, r"#(.*)$", 1)).alias("subpath"),
    ).dropFields("unused"))


def scope_of_path(path: Column) -> Column:
    """``test`` or ``development`` by a path's segments, else ``runtime``."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    tests = F.arrays_overlap(parts, F.array(*map(F.lit, ("test", "tests", "__tests__", "spec")))) | name.rlike(r"(^test_|_test\.|\.test\.|\.spec\.|^conftest\.py$)")
    tools = F.arrays_overlap(parts, F.array(*map(F.lit, ("scripts", "tools", "docs", "examples", "benchmarks"))))
    return F.when(tests, "test").when(tools, "development").otherwise("runtime")


def source_scope(ecosystem: Column, path: Column) -> Column:
    """The scope of a source file by its ecosystem's conventions; ``path`` is relative to its project (fixed values: folder and file names)."""
    parts, name = F.split(F.lower(path), "/"), F.lower(F.element_at(F.split(path, "/"), -1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    lies_in = lambda where, *names: F.arrays_overlap(where, F.array(*map(F.lit, names)))
    python = lies_in(folders, "test", "tests") | name.rlike(r"^test_|_test\.py$|^conftest\.py$")
    npm = lies_in(parts, "__tests__", "spec", "specs", "test", "tests") | stem.rlike(r"\.(test|spec)$") | stem.isin("playwright.config", "vitest.config", "jest.config", "karma.config")
    go = name.endswith("_test.go") | lies_in(parts, "test")
    cargo = F.element_at(parts, 1).isin("tests", "benches", "examples")
    build = ((ecosystem == "npm") & stem.isin("astro.config", "vite.config", "webpack.config", "rollup.config")) | ((ecosystem == "cargo") & (F.lower(path) == "build.rs"))
    test = F.when(ecosystem == "pypi", python).when(ecosystem == "npm", npm).when(ecosystem == "go", go).when(ecosystem == "cargo", cargo).otherwise(F.lit(False))
    return F.when(test, "test").when(build, "build").otherwise("runtime")


def escape_terminal(text: Column) -> Column:
    """Control characters but newline and tab, and direction marks, become question marks."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F-\x9F‎‏‪-‮⁦-⁩]", "?")
