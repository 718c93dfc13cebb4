"""Null, empty, cut-off and foreign texts: every parser gives rows or problems, never an error."""

import pytest
from pyspark.sql import functions as F

from lodestrata.plans import callgraph, scan
from lodestrata.sources import builds, manifests, positions, settings

TEXTS = [None, "", "{bad", "]\x00[", "[x]\ny", "<a><b>", "[1, 2]", '"text"', "a: [b\n", "import {", "[[package]]\n", "{}", "x = 1\n", "\\\n", "()" * 2000]
PARSERS = {
    **{n: getattr(manifests, n) for n in "requirements includes package_json package_lock package_lock_v1 npmrc go_mod go_replaces go_sum gradle_lockfile cargo_lock pom_facts pom vcpkg_json java_imports c_includes js_loads python_imports pyproject toml_lock toml_lock_edges lock_hashes pipfile_lock pnpm_lock".split()},
    **{n: getattr(builds, n) for n in "gradle_dependencies version_catalog cargo_toml pipfile setup_cfg script_metadata pip_commands yarn_lock go_imports css_imports component_scripts rust_references conanfile cmake_commands bazel_deps script_commands workflow_commands tsconfig_types setup_py python_tasks uv_sources conan_lock vcpkg_pins cargo_overrides pytest_plugins".split()},
    "json_keys": positions.json_keys, "ini_keys": positions.ini_keys, "configuration": settings.configuration, "records": lambda f: settings.records(f, "abi"), "policy": lambda f: settings.policy(f)[1], "python_calls": scan.python_calls, "call_facts": callgraph.facts,
}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(TEXTS)], "path string, text string").cache()


@pytest.mark.parametrize("name", PARSERS)
def test_odd_texts(odd, name):
    got = PARSERS[name](odd)
    assert "path" in got.columns and got.count() >= 0 and PARSERS[name](odd.limit(0)).count() == 0


def test_scan_of_odd_files(spark, odd):
    names = ["package.json", "pyproject.toml", "package-lock.json", "i.js", "m.py"]
    files = odd.select("path", "text", F.explode(F.array(*map(F.lit, names))).alias("name")).select(F.concat("path", F.lit("/"), "name").alias("path"), "text")
    found = scan.scan(files)
    assert found["findings"].count() >= 0 and found["diagnostics"].where("project_id is null").count() == 0
    assert {r.check for r in scan.export_problems(found).collect()} <= {"usages.no-package"}
