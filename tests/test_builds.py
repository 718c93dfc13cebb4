import base64
import configparser
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from packaging.requirements import InvalidRequirement, Requirement
from pyspark.sql import functions as F

from lodestrata.operators import constraints
from lodestrata.sources import builds, evidence_files, manifests

from .test_sources import rows, table, write


def test_jvm(spark):
    text = "dependencies {\n  implementation 'g:a:1.0'\n  testImplementation(\"g:b\")\n  // api 'no:no:1'\n  implementation platform('g:bom:2')\n  api \"g:$x:1\"\n}\n"
    assert rows(builds.gradle_dependencies(table(spark, g=text)), "line", "package", "constraint_raw", "scope") == [(2, "g:a", "1.0", "runtime"), (3, "g:b", None, "test"), (5, "g:bom", "2", "build")]
    toml = '[versions]\nv = "1.2"\n[libraries]\na-b = {module = "g:a", version.ref = "v"}\nc = "g:c:3"\nd = {group = "g", name = "d", version = {strictly = "4"}}\n'
    assert rows(builds.version_catalog(table(spark, c=toml, bad="[")).where("problem is null"), "alias", "package", "constraint_raw") == [("a.b", "g:a", "1.2"), ("c", "g:c", "3"), ("d", "g:d", "4")]


def test_cargo(spark):
    toml = '[dependencies]\na = "1"\nb = {package = "bb", workspace = true}\n[dev-dependencies]\nc = {version = "2", optional = true}\n[target.x.build-dependencies]\nd = "3"\n'
    own = builds.cargo_toml(table(spark, c=toml))
    assert rows(own, "package", "alias", "constraint_raw", "scope") == sorted([("a", "a", "1", "runtime"), ("bb", "b", None, "runtime"), ("c", "c", "2", "optional"), ("d", "d", "3", "build")], key=repr)
    ws = spark.createDataFrame([("w", "b", "9")], "workspace string, alias string, constraint_raw string")
    assert rows(builds.inherit_workspace(own.withColumn("workspace", F.lit("w")), ws).where("alias = 'b'"), "constraint_raw") == [("9",)]
    rust = "use serde::X;\nuse std::io;\n// use no::x;\nextern crate rand;\nuse crate::y;\n"
    assert rows(builds.rust_references(table(spark, r=rust)), "line", "reference") == [(1, "serde"), (4, "rand")]


def test_python_files(spark):
    assert rows(builds.pipfile(table(spark, p='[packages]\na = "*"\n[dev-packages]\nb = {version = "==1"}\n[docs]\nc = "*"\n')), "display_name", "constraint_raw", "group") == [("a", "*", "runtime"), ("b", "==1", "development"), ("c", "*", "pipenv:docs")]
    assert rows(builds.setup_cfg(table(spark, s="[options]\ninstall_requires =\n  a>=1\n  b; python_version < '3'\n[options.extras_require]\nx =\n  c\n")), "display_name", "constraint_raw", "group") == [("a", ">=1", "runtime"), ("b", "", "runtime"), ("c", "", "extra:x")]
    script = '#!/x\n# /// script\n# dependencies = ["a>1"]\n# ///\nimport a\n'
    assert rows(builds.script_metadata(table(spark, s=script)), "display_name", "constraint_raw") == [("a", ">1")]
    assert rows(builds.pip_commands(table(spark, d="RUN pip install -U A_b==1 'c>2' \\\n  -r r.txt ./local && echo no\n")), "package", "constraint_raw") == [("a-b", "==1"), ("c", ">2")]


def test_javascript_files(spark):
    lock = '__metadata:\n  version: 8\n\n"a@npm:^1, a@npm:^1.2":\n  version: 1.2.0\n  resolution: "a@npm:1.2.0"\n\n"@s/b@npm:2":\n  version: 2.0.0\n'
    assert rows(builds.yarn_lock(table(spark, y=lock)), "descriptor", "package", "version") == [("@s/b@npm:2", "@s/b", "2.0.0"), ("a@npm:^1", "a", "1.2.0"), ("a@npm:^1.2", "a", "1.2.0")]
    assert rows(builds.css_imports(table(spark, c="@import 'a.css';\n/* @import 'no' */\n@import url(\"b\");")), "reference") == [("a.css",), ("b",)]
    assert rows(builds.component_scripts(table(spark, v="<template/><script setup>import 'a'</script>")), "text") == [("import 'a'\n",)]
    doc = json.dumps({"scripts": {"a": "NODE=1 eslint .", "b": "a && b", "c": "npx jest", "d": "cd x"}})
    assert rows(builds.script_commands(table(spark, p=doc)), "script", "executable", "supported") == [("a", "eslint", True), ("b", "a", False), ("c", "jest", True), ("d", "cd", False)]
    assert rows(builds.tsconfig_types(table(spark, t=json.dumps({"compilerOptions": {"types": ["node", "@s/x/y", "./z"]}}))), "package") == [("@s/x",), ("@types/node",)]
    assert rows(builds.workflow_commands(table(spark, w="jobs:\n  t:\n    steps:\n      - run: pytest\n      - run: |\n          a\n          b\n      - uses: x\n")), "job", "command") == [("t", "a"), ("t", "b"), ("t", "pytest")]


def test_native_files(spark):
    assert rows(builds.conanfile(table(spark, c="[requires]\nzlib/1.2\n[tool_requires]\ncmake/3.0\n", p='self.requires("fmt/10")\nself.test_requires("gtest/1.0")\n')), "package", "constraint_raw", "scope") == [("cmake", "3.0", "build"), ("fmt", "10", "runtime"), ("gtest", "1.0", "test"), ("zlib", "1.2", "runtime")]
    assert rows(builds.cmake_commands(table(spark, c="find_package(Boost 1.7 REQUIRED)\n# find_package(No)\nfind_package(${X})\nFetchContent_Declare(fmt\n GIT_REPOSITORY x\n GIT_TAG 10.0)\n")), "package", "version", "kind") == [("Boost", "1.7", "find_package"), ("fmt", "10.0", "fetch_content")]
    assert rows(builds.bazel_deps(table(spark, b='bazel_dep(name = "a", version = "1")\nbazel_dep(\n name="b", dev_dependency = True)\n# bazel_dep(name = "no")\n')), "package", "version", "dev") == [("a", "1", False), ("b", None, True)]
    assert rows(builds.go_imports(table(spark, g='import "fmt"\nimport (\n  x "a/b"\n  // "no"\n  "c/d"\n)\n')), "reference") == [("a/b",), ("c/d",), ("fmt",)]


def test_evidence_files(spark, tmp_path):
    record = {"cveMetadata": {"cveId": "CVE-1", "state": "PUBLISHED"}, "containers": {"cna": {"title": "t", "providerMetadata": {"shortName": "n"}}, "adp": [{"title": "u"}]}}
    assert rows(evidence_files.cve(spark, write(tmp_path, "c.json", record)), "cve", "container", "title") == [("CVE-1", "adp", "u"), ("CVE-1", "cna", "t")]
    statement = json.dumps({"predicateType": "p", "subject": [{"name": "a", "digest": {"sha256": "d"}}]})
    assert rows(evidence_files.attestations(spark, write(tmp_path, "a.json", {"payload": base64.b64encode(statement.encode()).decode()})), "predicate_type", "subject", "sha256") == [("p", "a", "d")]
    assert rows(evidence_files.pip_report(spark, write(tmp_path, "p.json", {"install": [{"metadata": {"name": "a", "version": "1"}, "requested": True}]})), "package", "requested") == [("a", True)]
    assert rows(evidence_files.scorecard(spark, write(tmp_path, "s.json", {"repo": {"name": "r"}, "checks": [{"name": "x", "score": -1}, {"name": "y", "score": 7}]})), "check", "score") == [("x", None), ("y", 7.0)]
    stream = "\n".join(json.dumps(x, indent=1) for x in ({"config": {}}, {"finding": {"osv": "G", "trace": [{"module": "m", "version": "v1", "function": "f"}]}}))
    (tmp_path / "g.json").write_text(stream)
    assert rows(evidence_files.govulncheck(spark, str(tmp_path / "g.json")), "ordinal", "osv", "module", "called") == [(1, "G", "m", True)]
    (tmp_path / "r").mkdir()
    for i, deps in (("a", ["b", "gone"]), ("b", [])):
        write(tmp_path / "r", f"target-{i}.json", {"id": i, "name": i, "type": "EXECUTABLE", "dependencies": [{"id": d} for d in deps]})
    targets, links = evidence_files.cmake_targets(spark, str(tmp_path / "r"))
    assert targets.count() == 2 and rows(links, "child", "present") == [("b", True), ("gone", False)]
    (tmp_path / "w.xml").write_text('<C><Weaknesses><Weakness ID="79" Name="n" Status="Stable"/><Weakness ID="80" Name="o" Status="Draft"/></Weaknesses></C>')
    assert rows(evidence_files.cwe(spark, str(tmp_path / "w.xml")), "cwe", "name") == [("CWE-79", "n"), ("CWE-80", "o")]


def test_constraints(spark):
    decl = [("p", "npm", "a", "^1"), ("p", "npm", "a", "^2"), ("p", "npm", "b", "^1"), ("p", "npm", "b", ">=1.5.0"), ("p", "npm", "c", "^1"), ("p", "npm", "c", "latest"), ("p", "npm", "d", "x"), ("p", "npm", "e", "tag")]
    df = spark.createDataFrame(decl, "project_id string, ecosystem string, package string, constraint_raw string")
    assert {r.package: r.conflict for r in constraints.semver_conflicts(df).collect()} == {"a": True, "b": False, "c": None, "d": False, "e": None}
    pins = [("pep440", "==1.0", True), ("pep440", "==1.*", False), ("semver", "1.2.3", True), ("semver", "^1.2.3", False), ("maven", "[1.0]", True), ("maven", "[1,2)", False), ("go", "v1.2.3", True), ("x", "1", False)]
    assert all(r.e == r.want for r in spark.createDataFrame(pins, "s string, r string, want boolean").select(constraints.exact_pin(F.col("s"), F.col("r")).alias("e"), "want").collect())
    refs = spark.createDataFrame([("cv2",), ("yaml",), ("new",)], "reference string")
    known = lambda *r: spark.createDataFrame(list(r), "reference string, package string")
    got = constraints.priority_lookup(refs, "reference", [("configured", known(("cv2", "mine"))), ("exact", known(("cv2", "opencv-python"), ("yaml", "pyyaml")))], F.col("reference"))
    assert rows(got, "reference", "package", "mapping_confidence") == [("cv2", "mine", "configured"), ("new", "new", "inferred"), ("yaml", "pyyaml", "exact")]
    req = spark.createDataFrame([("m", "v1"), ("n", "v1"), ("o", "v1")], "package string, version string")
    rep = spark.createDataFrame([("m", "v1", "x", "v9"), ("m", None, "y", "v8"), ("n", None, "../n", None)], "package string, old_version string, new_package string, new_version string")
    assert rows(constraints.effective_go_version(req, rep), "package", "effective_package", "effective_version") == sorted([("m", "x", "v9"), ("n", "../n", None), ("o", "o", "v1")], key=repr)
    marks = spark.createDataFrame([("python_version >= '3.8'",), ("python_version < '3'",), ("nonsense ?",), (None,)], "m string")
    assert [r.h for r in marks.select(constraints.markers({"python_version": "3.12"})(F.col("m")).alias("h")).collect()] == [True, False, None, True]
    lines = spark.createDataFrame([("r", 1, "a==1.0  # c", "a", "==1.0"), ("r", 2, "b>=1", "b", ">=1")], "path string, line int, text string, package string, constraint_raw string")
    assert rows(constraints.update_preview(lines, spark.createDataFrame([("a", "2.0"), ("b", "3")], "package string, version string")), "new_text") == [("a==2.0  # c",)]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["[a]", "[options]", "[DEFAULT]", "[]", "[x] ]", "a = 1", "b: 2", "A=3", "=x", "k", "  c", "  [d]", " # e", "; f", "", "   ", "\t g = h", "i =", "j = k : l", "m : n = o", "\x1c", "é = ü\r", "  - p"]), max_size=9))
def test_ini_texts_are_read_as_the_library_does(lines):
    text = "\n".join(lines)
    c = configparser.RawConfigParser()
    try:
        c.read_string(text)
        want = {s: dict(c.items(s)) for s in c.sections()}
    except configparser.Error as e:
        want = str(e)
    try:
        got = builds._ini(text)
    except ValueError as e:
        got = str(e)
    assert got == want


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aB1.-_ \t=<>!~,*;[]", max_size=9) | st.from_regex(r"[ab1][ab1._-]{0,3} ?(==|>=|<=|!=|<|>|~=|===) ?[01]{1,2}(\.[01]{1,2}){0,2}(a1|\.\*)?", fullmatch=True))
def test_requirements_are_read_as_the_library_does(text):
    try:
        r = Requirement(text)
        want = (r.name, str(r.specifier), str(r.marker) if r.marker else None)
    except InvalidRequirement:
        want = None
    try:
        got = manifests._requirement(text)
    except InvalidRequirement:
        got = None
    assert got == want


def test_plain_ini_files_and_requirements_need_no_library(monkeypatch):
    def refuse(*_):
        raise AssertionError("read by the library")

    monkeypatch.setattr(configparser.RawConfigParser, "read_string", refuse)
    monkeypatch.setattr(Requirement, "__init__", refuse)
    assert builds._ini("[pytest]\naddopts = -q\n  -p x\n") == {"pytest": {"addopts": "-q\n-p x"}}
    assert manifests._requirement("  A1>=1.2") == ("A1", ">=1.2", None)
