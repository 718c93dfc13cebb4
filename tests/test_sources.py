import gzip
import json

import pytest

from lodestrata.sources import feeds, files, manifests


def table(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/"), t) for k, t in texts.items()], "path string, text string")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_read_files(spark, tmp_path):
    for name, text in {"a/x.py": b"import os\r\nimport re\r", "node_modules/y.py": b"", "gen/out/z.py": b"", "big.py": b"x" * 50}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text)
    got = files.read_files(spark, str(tmp_path), "*.py", [*files.EXCLUDED, "gen/out"], max_bytes=40)
    assert rows(got, "path", "text", "problem") == sorted([("a/x.py", "import os\nimport re\n", None), ("big.py", None, "file.too-large")], key=repr)


def test_requirements(spark):
    text = "# c\nDjango_X[a, b]>=1.0,<2  # why\n-r more.txt\nrequests==2.0; python_version<'3'\nlong \\\n  >=1\nhttps://x\n"
    assert rows(manifests.requirements(table(spark, r=text)), "package", "constraint_raw", "marker", "extras") == sorted(
        [("django-x", ">=1.0,<2", None, ["a", "b"]), ("requests", "==2.0", "python_version<'3'", None), ("long", ">=1", None, None)], key=repr
    )
    assert rows(manifests.includes(table(spark, **{"d__r.txt": text})), "target", "kind") == [("d/more.txt", "requirement")]


def test_package_json(spark):
    doc = {"dependencies": {"a": "^1", "b": "1"}, "optionalDependencies": {"b": "2"}, "devDependencies": {"c": "*"}}
    assert rows(manifests.package_json(table(spark, p=json.dumps(doc), bad="{")), "package", "constraint_raw", "scope") == [("a", "^1", "runtime"), ("b", "2", "optional"), ("c", "*", "development")]


def test_package_lock_edges(spark):
    packages = {"": {"dependencies": {"a": "1", "b": "1"}}, "node_modules/a": {"version": "1.0.0", "dependencies": {"b": "2", "zz": "1"}}, "node_modules/b": {"version": "1.0.0"}, "node_modules/a/node_modules/b": {"version": "2.0.0", "dependencies": {"a": "1"}}}
    inst = manifests.package_lock(table(spark, p=json.dumps({"lockfileVersion": 3, "packages": packages}), old=json.dumps({"lockfileVersion": 1})))
    assert rows(inst, "instance", "package", "direct")[1:] == [("node_modules/a", "a", True), ("node_modules/a/node_modules/b", "b", False), ("node_modules/b", "b", True)]
    got = {(r.parent, r.child): r.target for r in manifests.npm_edges(inst).collect()}
    assert got == {("", "a"): "node_modules/a", ("", "b"): "node_modules/b", ("node_modules/a", "b"): "node_modules/a/node_modules/b", ("node_modules/a", "zz"): None, ("node_modules/a/node_modules/b", "a"): "node_modules/a"}


def test_go(spark):
    mod = 'module m\nrequire example.com/one v1.0.0\nrequire (\n  example.com/two v2.0.0 // indirect\n  // example.com/no v1.0.0\n)\nreplace example.com/x => ../x\n'
    assert rows(manifests.go_mod(table(spark, m=mod)), "package", "version", "indirect") == [("example.com/one", "v1.0.0", False), ("example.com/two", "v2.0.0", True)]
    assert rows(manifests.go_sum(table(spark, s="a v1 h1:x=\nbad line\na v1/go.mod h1:y=\n")), "package", "version", "checksum") == [("a", "v1", "h1:x="), ("a", "v1/go.mod", "h1:y=")]


def test_gradle_lockfile(spark):
    text = "# x\ng:a:1.0=compile,test\ng:a:1.0=compile\nempty=\n"
    assert rows(manifests.gradle_lockfile(table(spark, g=text)), "instance") == [("compile:g:a:1.0#1",), ("compile:g:a:1.0#2",), ("test:g:a:1.0#1",)]


def test_cargo_lock(spark):
    text = 'version = 3\n\n[[package]]\nname = "a"\nversion = "1.0.0"\ndependencies = [\n "b",\n "c 2.0.0",\n]\n\n[[package]]\nname = "b"\nversion = "1.0.0"\nsource = "registry+x"\n' + "".join(f'\n[[package]]\nname = "c"\nversion = "{v}"\n' for v in ("1.0.0", "2.0.0"))
    packages = manifests.cargo_lock(table(spark, c=text))
    assert rows(manifests.cargo_edges(packages), "child", "n_candidates", "child_version") == [("b", 1, "1.0.0"), ("c", 1, "2.0.0")]


def test_pom(spark):
    text = """<project xmlns="http://maven.apache.org/POM/4.0.0"><properties><v>1.5</v></properties><dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>m</artifactId></dependency></dependencies></dependencyManagement>
    <dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency><dependency><groupId>g</groupId><artifactId>b</artifactId><version>2</version><scope>test</scope></dependency></dependencies></project>"""
    assert rows(manifests.pom(table(spark, p=text, evil="<!DOCTYPE x><project/>")), "package", "constraint_raw", "scope") == [("g:a", "1.5", "runtime"), ("g:b", "2", "test")]


def test_vcpkg(spark):
    doc = {"dependencies": ["fmt", {"name": "zlib", "version>=": "1.2", "host": True}]}
    assert rows(manifests.vcpkg_json(table(spark, v=json.dumps(doc))), "package", "minimum", "scope") == [("fmt", None, "runtime"), ("zlib", "1.2", "host")]


def test_source_references(spark):
    assert rows(manifests.java_imports(table(spark, j="package x;\nimport a.b.C;\nimport static d.E.*;\n// import no.X;\n")), "line", "reference") == [(2, "a.b.C"), (3, "d.E")]
    assert rows(manifests.c_includes(table(spark, c='#include <a/b.h>\n# include "x.h"\n#include MACRO\n')), "reference", "quoted") == [("a/b.h", False), ("x.h", True)]
    js = "import a from 'a';\nimport 'side';\nconst b = require(\"@s/b/c\");\nimport('dyn');\nrequire(name);\n// require('no')\n/* import x from 'no' */\nexport * from './local';\n"
    loads = manifests.js_loads(table(spark, j=js))
    assert rows(loads, "line", "reference", "kind") == [(1, "a", "regular"), (2, "side", "regular"), (3, "@s/b/c", "regular"), (4, "dyn", "dynamic"), (8, "./local", "regular")]
    assert rows(loads.select(manifests.npm_package().alias("p")), "p") == sorted([("a",), ("side",), ("@s/b",), ("dyn",), (None,)], key=repr)


def test_python_imports(spark):
    text = "import os, a.b\ntry:\n    import c\nexcept ImportError:\n    c = None\nfrom .x import y\nif TYPE_CHECKING:\n    from d import e\nimportlib.import_module('f')\n"
    got = manifests.python_imports(table(spark, ok=text, bad="def", nb=json.dumps({"cells": [{"cell_type": "code", "source": ["%magic\n", "import g\n"]}]})))
    assert rows(got.where("problem is null"), "path", "reference", "kind") == [("nb", "g", "regular"), ("ok", "a.b", "regular"), ("ok", "c", "optional"), ("ok", "d", "typing"), ("ok", "f", "dynamic"), ("ok", "os", "regular")]
    assert rows(manifests.problems(got, "python.syntax"), "code", "path") == [("python.syntax", "bad")]


def test_toml(spark):
    text = '[project]\ndependencies = ["A>=1"]\n[project.optional-dependencies]\nx = ["b"]\n[dependency-groups]\ndev = ["c", {include-group = "more"}]\nmore = ["d"]\n[tool.poetry.dependencies]\npython = "^3"\ne = "^1"\n'
    got = manifests.pyproject(table(spark, p=text, cycle='[dependency-groups]\na = [{include-group = "b"}]\nb = [{include-group = "a"}]\n'))
    assert rows(got.where("problem is null"), "display_name", "constraint_raw", "group") == [("A", ">=1", "runtime"), ("b", "", "extra:x"), ("c", "", "group:dev"), ("d", "", "group:dev"), ("d", "", "group:more"), ("e", "^1", "runtime")]
    assert got.where("path = 'cycle' and problem is not null").count() == 1
    assert rows(manifests.toml_lock(table(spark, l='[[package]]\nname = "a"\nversion = "1"\n', p='lock-version = "1.0"\n[[packages]]\nname = "b"\nversion = "2"\n')), "display_name", "version") == [("a", "1"), ("b", "2")]


def test_pipfile_and_pnpm_locks(spark):
    assert rows(manifests.pipfile_lock(table(spark, p=json.dumps({"_meta": {}, "default": {"a": {"version": "==1.0"}}, "develop": {"b": {"version": "==2.0"}}}))), "package", "version", "category") == [("a", "1.0", "default"), ("b", "2.0", "develop")]
    text = "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n      a: {specifier: ^1, version: 1.0.0}\nsnapshots:\n  a@1.0.0:\n    dependencies:\n      b: 2.0.0\n  b@2.0.0: {}\n"
    assert rows(manifests.pnpm_lock(table(spark, p=text)), "source", "target") == [("a@1.0.0", "b@2.0.0"), ("importer:.", "a@1.0.0")]


def write(tmp_path, name, doc):
    (tmp_path / name).write_text(json.dumps(doc))
    return str(tmp_path / name)


def test_feeds(spark, tmp_path):
    kev = {"count": 1, "vulnerabilities": [{"cveID": "CVE-1", "dateAdded": "2024-01-02", "dueDate": "2024-02-02"}]}
    listed = feeds.kev(spark, write(tmp_path, "kev.json", kev))
    with pytest.raises(Exception, match="KEV count"):
        feeds.kev(spark, write(tmp_path, "bad.json", kev | {"count": 2})).collect()
    with gzip.open(tmp_path / "e.csv.gz", "wt") as f:
        f.write("#model_version:v,score_date:d\ncve,epss,percentile\nCVE-1,0.5,0.9\nCVE-2,1.5,x\n")
    scores = feeds.epss(spark, str(tmp_path / "e.csv.gz"))
    assert rows(scores, "cve", "score") == [("CVE-1", 0.5), ("CVE-2", None)]
    refs = spark.createDataFrame([("i", "CVE-1"), ("i", "CVE-3")], "identity string, cve string")
    assert rows(feeds.risk_context(refs, listed, scores), "cve", "kev_status", "epss") == [("CVE-1", "listed", 0.5), ("CVE-3", "not-listed", None)]


def test_cyclonedx_and_vex(spark, tmp_path):
    doc = {"bomFormat": "CycloneDX", "specVersion": "1.5", "components": [{"bom-ref": "a", "name": "a", "version": "1"}, {"bom-ref": "b", "name": "b"}], "dependencies": [{"ref": "a", "dependsOn": ["b", "gone"]}]}
    components, edges, dangling = feeds.cyclonedx(spark, write(tmp_path, "s.json", doc))
    assert rows(edges, "parent", "child") == [("a", "b")] and rows(dangling, "child") == [("gone",)]
    assert feeds.sbom_quality(components).first().asDict() == {"n_components": 2, "n_ref": 2, "n_name": 2, "n_version": 1, "n_purl": 0}
    vex = {"statements": [{"vulnerability": {"name": "V"}, "products": [{"@id": "p"}, {"@id": "q"}], "status": "fixed"}]}
    assert rows(feeds.vex(spark, write(tmp_path, "v.json", vex)), "vulnerability", "product", "status") == [("V", "p", "fixed"), ("V", "q", "fixed")]


def test_lines_keep_their_numbers(spark):
    c = '/* one\n two */ #include <a.h>\n// #include "no.h"\n#if X /* \n * ** \n*/\n#include "b.h"\n#endif\nchar *s = "/*";\n  # include <c/d.h> // "x"\n#include MACRO\n/* open\n#include <e.h>'
    got = manifests.c_includes(spark.createDataFrame([("f.c", c), ("g.c", None)], "path string, text string")).collect()
    assert sorted(map(tuple, got)) == [("f.c", 2, "a.h", False, False), ("f.c", 7, "b.h", True, True), ("f.c", 10, "c/d.h", False, False)]
    r = "a \\\n==1\n# c\nb \\\n\\\n>=2\nc==3\\"
    rows = manifests.requirements(spark.createDataFrame([("r.txt", r), ("r.txt", r)], "path string, text string")).select("line", "package", "constraint_raw").collect()
    assert sorted(map(tuple, rows)) == sorted([(1, "a", "==1"), (4, "b", ">=2"), (7, "c", "==3")] * 2)
