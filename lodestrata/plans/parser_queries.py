"""Parsers on generated files: one file for each part, in the parser's own format, with its key in names and versions.

The SQL never sees the texts: it says which rows a file of that part must give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.lineage import spread
from lodestrata.sources import builds, manifests, settings

from .driver_queries import ORACLE, QUERIES, _query, _t


def _parser(name: str, template: str, columns: list[str], rows: list[tuple], read, at: str = "f{k}"):
    """Registers a query: ``read`` over the files of ``template``, where ``{k}`` is the part's key, ``{m}`` its rest of 7 and ``{b}`` its backslash.

    ``rows``: SQL expressions over ``k`` and ``m`` for ``columns``, with one more for the condition under which the row is there.
    """

    def run(spark, sf_dir):
        key, rest = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 7).cast("string")
        fill = lambda t: F.replace(F.replace(F.replace(F.lit(t), F.lit("{k}"), key), F.lit("{m}"), rest), F.lit("{b}"), F.lit("\\"))
        files = spread(_t(spark, sf_dir, "part").select("p_partkey")).select(fill(at).alias("path"), fill(template).alias("text"))
        out = read(files)
        kinds = dict(out.dtypes)
        return out.select(*[(F.col(f"`{c}`").cast("string") if kinds[c] not in ("boolean", "string") else F.col(f"`{c}`")).alias(c) for c in columns])

    run.__name__ = name
    QUERIES[name] = run
    path = "'" + at.replace("{k}", "' || k || '").replace("{m}", "' || m || '") + "'"
    parts = [f"""select {', '.join(f'{path if e == "path" else e} as "{c}"' for c, e in zip(columns, row, strict=False))} from p where {row[len(columns)] if len(row) > len(columns) else 'true'}""" for row in rows]
    ORACLE[name] = "with p as (select p_partkey k, p_partkey % 7 m from part) " + " union all ".join(parts)


def _fine(df):
    return df.where("problem is null")


_parser(
    "parse_requirements",
    "# c\nPkg_{k}[x, y] >=1.{m}, <2 ; python_version<'3.{m}'  # why\n-r more.txt\nlong{k} {b}\n  ==1.{m} {b}\n  --hash=sha256:aa --hash=sha256:bb\nurl{k} @ https://h/u{k}.zip ; os_name=='x'\nplain.{k}\n--index-url https://x\n",
    ["path", "line", "package", "constraint_raw", "marker", "url"],
    [("path", "'2'", "'pkg-' || k", "'>=1.' || m || ', <2'", "'python_version<''3.' || m || ''''", "cast(null as varchar)"), ("path", "'4'", "'long' || k", "'==1.' || m", "null", "null"), ("path", "'7'", "'url' || k", "''", "'os_name==''x'''", "'https://h/u' || k || '.zip'"), ("path", "'8'", "'plain-' || k", "''", "null", "null")],
    manifests.requirements,
)
_parser("parse_includes", "-r a{k}.txt\nx\n--constraint=../c{m}.txt\n", ["path", "target", "kind"], [("path", "'d' || m || '/a' || k || '.txt'", "'requirement'"), ("path", "'d' || m || '/../c' || m || '.txt'", "'constraint'")], manifests.includes, "d{m}/r{k}.txt")
_parser(
    "parse_package_json", '{"dependencies":{"a{k}":"^{m}","b":"1"},"optionalDependencies":{"b":"2"},"devDependencies":{"@s/c":"*"},"peerDependencies":{"d{m}":"x"}}', ["path", "package", "constraint_raw", "scope"],
    [("path", "'a' || k", "'^' || m", "'runtime'"), ("path", "'b'", "'2'", "'optional'"), ("path", "'@s/c'", "'*'", "'development'"), ("path", "'d' || m", "'x'", "'peer'")], manifests.package_json,
)
_LOCK3 = '{"lockfileVersion":3,"packages":{"":{"dependencies":{"a":"1"}},"node_modules/a":{"version":"{m}.0.0","dependencies":{"b":"2","zz":"1"}},"node_modules/b":{"version":"1.{k}.0"},"node_modules/a/node_modules/b":{"version":"2.0.0","dependencies":{"a":"1"}}}}'
_parser("parse_package_lock", _LOCK3, ["path", "instance", "package", "version", "direct"], [("path", "''", "cast(null as varchar)", "cast(null as varchar)", "false"), ("path", "'node_modules/a'", "'a'", "m || '.0.0'", "true"), ("path", "'node_modules/b'", "'b'", "'1.' || k || '.0'", "true"), ("path", "'node_modules/a/node_modules/b'", "'b'", "'2.0.0'", "false")], manifests.package_lock)
_parser(
    "npm_lock_edges", _LOCK3, ["path", "parent", "child", "request", "target"],
    [("path", "''", "'a'", "'1'", "'node_modules/a'"), ("path", "'node_modules/a'", "'b'", "'2'", "'node_modules/a/node_modules/b'"), ("path", "'node_modules/a'", "'zz'", "'1'", "null"), ("path", "'node_modules/a/node_modules/b'", "'a'", "'1'", "'node_modules/a'")],
    lambda f: manifests.npm_edges(manifests.package_lock(f)),
)
_LOCK1 = '{"lockfileVersion":1,"dependencies":{"a":{"version":"{m}.0.0","requires":{"b":"2"},"dependencies":{"b":{"version":"2.{k}.0","integrity":"h"}}},"b":{"version":"1.0.0"}}}'
_parser("parse_package_lock_v1", _LOCK1, ["path", "instance", "package", "version", "integrity", "direct"], [("path", "'node_modules/a'", "'a'", "m || '.0.0'", "null", "true"), ("path", "'node_modules/a/node_modules/b'", "'b'", "'2.' || k || '.0'", "'h'", "false"), ("path", "'node_modules/b'", "'b'", "'1.0.0'", "null", "true")], manifests.package_lock_v1)
_parser("npm_lock_v1_edges", _LOCK1, ["path", "parent", "child", "target"], [("path", "'node_modules/a'", "'b'", "'node_modules/a/node_modules/b'")], lambda f: manifests.npm_edges(manifests.package_lock_v1(f)))
_parser(
    "npm_registry_origins", "registry=https://one/\n@s{m}:registry = https://corp/{k}/\n//corp/:_authToken=x\nregistry=https://r{m}.org\n", ["path", "package", "registry", "public"],
    [("path", "'@s' || m || '/x'", "'https://corp/' || k", "false"), ("path", "'@other/y'", "'https://r' || m || '.org'", "false"), ("path", "'plain'", "'https://r' || m || '.org'", "false")],
    lambda f: manifests.npm_origins(f.select("path", F.explode(F.array(F.regexp_extract("text", "(@s.)", 1), F.lit("@other"), F.lit("plain"))).alias("p")).select("path", F.when(F.col("p") == "plain", "plain").when(F.col("p") == "@other", "@other/y").otherwise(F.concat("p", F.lit("/x"))).alias("package")), manifests.npmrc(f)),
)
_GOMOD = "module m\nrequire ex.com/one{k} v1.{m}.0\nrequire (\n  ex.com/two v2.0.0 // indirect\n  // ex.com/no v1.0.0\n)\nreplace ex.com/x v1.0.0 => ../x{m}\nreplace (\n  ex.com/y => ex.com/z{k} v3.0.0\n)\nexclude ex.com/w v0.{m}.0\n"
_parser("parse_go_mod", _GOMOD, ["path", "package", "version", "indirect"], [("path", "'ex.com/one' || k", "'v1.' || m || '.0'", "false"), ("path", "'ex.com/two'", "'v2.0.0'", "true")], manifests.go_mod)
_parser("parse_go_replaces", _GOMOD, ["path", "kind", "package", "version", "target", "target_version"], [("path", "'replace'", "'ex.com/x'", "'v1.0.0'", "'../x' || m", "cast(null as varchar)"), ("path", "'replace'", "'ex.com/y'", "null", "'ex.com/z' || k", "'v3.0.0'"), ("path", "'exclude'", "'ex.com/w'", "'v0.' || m || '.0'", "null", "null")], manifests.go_replaces)
_parser("parse_go_sum", "a{k} v1 h1:x=\nbad line\na{k} v1/go.mod h1:y{m}=\n", ["path", "line", "package", "version", "checksum"], [("path", "'1'", "'a' || k", "'v1'", "'h1:x='"), ("path", "'3'", "'a' || k", "'v1/go.mod'", "'h1:y' || m || '='")], manifests.go_sum)
_parser("parse_gradle_lockfile", "# x\ng:a{k}:1.{m}=compile,test\ng:a{k}:1.{m}=compile\nempty=\n", ["path", "instance"], [("path", "'compile:g:a' || k || ':1.' || m || '#1'"), ("path", "'compile:g:a' || k || ':1.' || m || '#2'"), ("path", "'test:g:a' || k || ':1.' || m || '#1'")], manifests.gradle_lockfile)
_CARGO = 'version = 3\n\n[[package]]\nname = "a{k}"\nversion = "1.{m}.0"\ndependencies = [\n "b",\n "c 2.0.0",\n "d",\n]\n\n[[package]]\nname = "b"\nversion = "1.0.0"\nsource = "registry+x"\n\n[[package]]\nname = "c"\nversion = "1.0.0"\n\n[[package]]\nname = "c"\nversion = "2.0.0"\n'
_parser("parse_cargo_lock", _CARGO, ["path", "package", "version", "source"], [("path", "'a' || k", "'1.' || m || '.0'", "null"), ("path", "'b'", "'1.0.0'", "'registry+x'"), ("path", "'c'", "'1.0.0'", "null"), ("path", "'c'", "'2.0.0'", "null")], manifests.cargo_lock)
_parser("cargo_lock_edges", _CARGO, ["path", "child", "n_candidates", "child_version"], [("path", "'b'", "'1'", "'1.0.0'"), ("path", "'c'", "'1'", "'2.0.0'"), ("path", "'d'", "'0'", "null")], lambda f: manifests.cargo_edges(manifests.cargo_lock(f)))
_POM = (
    '<project xmlns="http://maven.apache.org/POM/4.0.0"><groupId>g</groupId><artifactId>p{k}</artifactId><version>{m}</version><parent><groupId>none</groupId><artifactId>x</artifactId><version>1</version></parent><properties><v>1.{m}</v></properties>'
    "<dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>managed</artifactId><version>${v}</version><scope>test</scope></dependency></dependencies></dependencyManagement>"
    "<!-- <dependencies><dependency><groupId>old</groupId><artifactId>o</artifactId></dependency></dependencies> --><dependencies><dependency><groupId>g</groupId><artifactId>a{k}</artifactId><version>${v}</version></dependency>"
    "<dependency><groupId>g</groupId><artifactId>managed</artifactId></dependency><dependency><groupId>g</groupId><artifactId>own</artifactId><version>${project.version}</version><scope>provided</scope></dependency><dependency><groupId>g</groupId><artifactId>open</artifactId><version>${w}</version></dependency></dependencies>"
    "<profiles><profile><dependencies><dependency><groupId>g</groupId><artifactId>prof</artifactId><version>2</version></dependency></dependencies></profile></profiles></project>"
)
_parser(
    "parse_pom", _POM, ["path", "package", "constraint_raw", "scope", "maven_kind"],
    [("path", "'g:a' || k", "'1.' || m", "'runtime'", "'dependency'"), ("path", "'g:managed'", "'1.' || m", "'test'", "'dependency'"), ("path", "'g:own'", "cast(m as varchar)", "'build'", "'dependency'"), ("path", "'g:open'", "'${w}'", "'runtime'", "'dependency'"), ("path", "'g:prof'", "'2'", "'runtime'", "'profile-dependency'")],
    manifests.pom,
)


def _family(f):
    """Each pom with a parent file beside it that has properties, managed versions and a dependency of its own."""
    parent = '<project><groupId>g</groupId><artifactId>parent{k}</artifactId><version>9</version><properties><v>5.{m}</v><u>p</u></properties><dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId><version>${v}</version></dependency></dependencies></dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>inherited</artifactId><version>${u}</version></dependency></dependencies></project>'
    k, m = F.regexp_extract("path", r"(\d+)", 1), (F.regexp_extract("path", r"(\d+)", 1).cast("long") % 7).cast("string")
    parents = f.select(F.concat(F.lit("parent"), k).alias("path"), F.replace(F.replace(F.lit(parent), F.lit("{k}"), k), F.lit("{m}"), m).alias("text"))
    bad = f.select(F.concat(F.lit("bad"), k).alias("path"), F.lit("<project><dep").alias("text"))
    return manifests.pom(f.unionByName(parents).unionByName(bad)).where(F.col("path").startswith("f"))


_parser(
    "pom_parents", "<project><artifactId>c{k}</artifactId><parent><groupId>g</groupId><artifactId>parent{k}</artifactId><version>9</version></parent><properties><u>own{m}</u></properties><dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId></dependency></dependencies></project>",
    ["path", "package", "constraint_raw", "maven_kind"], [("path", "'g:m'", "'5.' || m", "'dependency'"), ("path", "'g:inherited'", "'own' || m", "'dependency'")], _family,
)
_VCPKG = '{"builtin-baseline":"abc{k}","dependencies":["fmt{m}",{"name":"zlib{k}","version>=":"1.{m}","host":true}],"overrides":[{"name":"zlib{k}","version":"1.2"},{"name":"q","version-string":"x{m}","port-version":3}]}'
_parser("parse_vcpkg_json", _VCPKG, ["path", "package", "minimum", "scope"], [("path", "'fmt' || m", "null", "'runtime'"), ("path", "'zlib' || k", "'1.' || m", "'host'")], manifests.vcpkg_json)
_parser("parse_vcpkg_pins", _VCPKG, ["path", "package", "version", "kind"], [("path", "'zlib' || k", "'1.2'", "'override'"), ("path", "'q'", "'x' || m || '#3'", "'override'"), ("path", "null", "'abc' || k", "'baseline'")], builds.vcpkg_pins)
_parser("parse_java_imports", "package x;\nimport a.b{k}.C;\nimport static d.E{m}.*;\n// import no.X;\n", ["path", "line", "reference"], [("path", "'2'", "'a.b' || k || '.C'"), ("path", "'3'", "'d.E' || m")], manifests.java_imports)
_parser("parse_c_includes", '#include <a/b{k}.h>\n#if X\n# include "x{m}.h"\n#endif\n/* #include "no.h" */\n#include MACRO\n#ifdef Y\n#endif\n#include "last.h"\n', ["path", "line", "reference", "quoted", "conditional"], [("path", "'1'", "'a/b' || k || '.h'", "false", "false"), ("path", "'3'", "'x' || m || '.h'", "true", "true"), ("path", "'9'", "'last.h'", "true", "false")], manifests.c_includes)
_parser(
    "parse_js_loads", "import {\n  one,\n  two,\n} from 'm{k}';\nimport 'side{m}';\n/* import x\n from 'no' */\nconst b = require(\"@s/b{k}/c\"), s = \"// import 'no'\";\nawait import( 'dyn' );\nrequire(name);\nexport * from './local';\nimport type { T } from \"types{m}\";\nconst t = `import 'no'`;\n",
    ["path", "line", "reference", "kind"],
    [("path", "'1'", "'m' || k", "'regular'"), ("path", "'5'", "'side' || m", "'regular'"), ("path", "'8'", "'@s/b' || k || '/c'", "'regular'"), ("path", "'9'", "'dyn'", "'dynamic'"), ("path", "'11'", "'./local'", "'regular'"), ("path", "'12'", "'types' || m", "'regular'")],
    manifests.js_loads,
)
_parser("parse_python_imports", "import os, a{k}.b\ntry:\n    import c{m}\nexcept ImportError:\n    c = None\nfrom .x import y\nif TYPE_CHECKING:\n    from d import e\nimportlib.import_module('f{k}')\n", ["path", "line", "reference", "kind"], [("path", "'1'", "'os'", "'regular'"), ("path", "'1'", "'a' || k || '.b'", "'regular'"), ("path", "'3'", "'c' || m", "'optional'"), ("path", "'8'", "'d'", "'typing'"), ("path", "'9'", "'f' || k", "'dynamic'")], lambda f: _fine(manifests.python_imports(f)))
_PYPROJECT = '[project]\ndependencies = ["A{k}>=1.{m}"]\n[project.optional-dependencies]\nx = ["b"]\n[dependency-groups]\ndev = ["c", {include-group = "more"}]\nmore = ["d{m}"]\n[tool.poetry.dependencies]\npython = "^3"\ne = "^{m}"\n[tool.pdm.dev-dependencies]\nlint = ["ruff"]\n[tool.uv]\ndev-dependencies = ["u{k}"]\n'
_parser(
    "parse_pyproject", _PYPROJECT, ["path", "display_name", "constraint_raw", "group"],
    [("path", "'A' || k", "'>=1.' || m", "'runtime'"), ("path", "'b'", "''", "'extra:x'"), ("path", "'c'", "''", "'group:dev'"), ("path", "'d' || m", "''", "'group:dev'"), ("path", "'d' || m", "''", "'group:more'"), ("path", "'e'", "'^' || m", "'runtime'"), ("path", "'ruff'", "''", "'group:lint'"), ("path", "'u' || k", "''", "'group:dev'")],
    lambda f: _fine(manifests.pyproject(f)),
)
_POETRY = '[[package]]\nname = "A_{k}"\nversion = "1.{m}"\nfiles = [{file = "x", hash = "sha256:h{k}"}]\n[package.dependencies]\nB = ">=2"\nc = {version = "*", markers = "os == \'x\'"}\n[[package]]\nname = "b"\nversion = "2"\n'
_parser("parse_toml_lock", _POETRY, ["path", "display_name", "version"], [("path", "'A_' || k", "'1.' || m"), ("path", "'b'", "'2'")], lambda f: _fine(manifests.toml_lock(f)))
_parser("parse_lock_edges", _POETRY, ["path", "package", "version", "child", "request", "marker"], [("path", "'a-' || k", "'1.' || m", "'b'", "'>=2'", "null"), ("path", "'a-' || k", "'1.' || m", "'c'", "'*'", "'os == ''x'''")], lambda f: _fine(manifests.toml_lock_edges(f)))
_parser("parse_lock_hashes", _POETRY, ["path", "package", "version", "hash"], [("path", "'A_' || k", "'1.' || m", "'sha256:h' || k")], lambda f: _fine(manifests.lock_hashes(f)))
_parser("parse_pipfile_lock", '{"_meta":{},"default":{"a{k}":{"version":"==1.{m}"}},"develop":{"b":{"version":"==2.0"}}}', ["path", "package", "version", "category"], [("path", "'a' || k", "'1.' || m", "'default'"), ("path", "'b'", "'2.0'", "'develop'")], manifests.pipfile_lock)
_parser("parse_pnpm_lock", "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n      a{k}: {specifier: ^1, version: 1.{m}.0}\nsnapshots:\n  a{k}@1.{m}.0:\n    dependencies:\n      b: 2.0.0\n  b@2.0.0: {}\n", ["path", "source", "target", "kind"], [("path", "'importer:.'", "'a' || k || '@1.' || m || '.0'", "'dependencies'"), ("path", "'a' || k || '@1.' || m || '.0'", "'b@2.0.0'", "'dependencies'")], lambda f: _fine(manifests.pnpm_lock(f)))
_parser("parse_gradle", "dependencies {\n  implementation 'g:a{k}:1.{m}'\n  // api 'no:no:1'\n  testImplementation(\"g:t:2\")\n  annotationProcessor 'g:p'\n}\n", ["path", "line", "package", "constraint_raw", "scope"], [("path", "'2'", "'g:a' || k", "'1.' || m", "'runtime'"), ("path", "'4'", "'g:t'", "'2'", "'test'"), ("path", "'5'", "'g:p'", "null", "'build'")], builds.gradle_dependencies)
_parser("parse_version_catalog", '[versions]\nv = "1.{m}"\n[libraries]\na-b{k} = {module = "g:a{k}", version.ref = "v"}\nc = "g:c:2"\n', ["path", "alias", "package", "constraint_raw"], [("path", "'a.b' || k", "'g:a' || k", "'1.' || m"), ("path", "'c'", "'g:c'", "'2'")], lambda f: _fine(builds.version_catalog(f)))
_CARGOTOML = '[dependencies]\na{k} = "1.{m}"\nw = {workspace = true}\n[dev-dependencies]\nt = {version = "2", package = "real{m}"}\n[target.x.build-dependencies]\nb = "3"\n[patch.crates-io]\nz = {git = "https://g/{k}"}\n[replace]\n"foo:0.{m}.0" = {path = "../foo"}\n'
_parser("parse_cargo_toml", _CARGOTOML, ["path", "package", "alias", "constraint_raw", "scope", "inherited"], [("path", "'a' || k", "'a' || k", "'1.' || m", "'runtime'", "'false'"), ("path", "'w'", "'w'", "null", "'runtime'", "'true'"), ("path", "'real' || m", "'t'", "'2'", "'test'", "'false'"), ("path", "'b'", "'b'", "'3'", "'build'", "'false'")], lambda f: _fine(builds.cargo_toml(f)))
_parser("parse_cargo_overrides", _CARGOTOML, ["path", "kind", "registry", "package", "version", "location"], [("path", "'patch'", "'crates-io'", "'z'", "null", "'https://g/' || k"), ("path", "'replace'", "null", "'foo'", "'0.' || m || '.0'", "'../foo'")], lambda f: _fine(builds.cargo_overrides(f)))
_parser("parse_pipfile", '[packages]\na{k} = "==1.{m}"\n[dev-packages]\nb = {version = "*"}\n[docs]\nc = "*"\n', ["path", "display_name", "constraint_raw", "group"], [("path", "'a' || k", "'==1.' || m", "'runtime'"), ("path", "'b'", "'*'", "'development'"), ("path", "'c'", "'*'", "'pipenv:docs'")], lambda f: _fine(builds.pipfile(f)))
_parser("parse_setup_cfg", "[options]\ninstall_requires =\n  A{k}>=1.{m}\n  b\n[options.extras_require]\nx = c\n", ["path", "display_name", "constraint_raw", "group"], [("path", "'A' || k", "'>=1.' || m", "'runtime'"), ("path", "'b'", "''", "'runtime'"), ("path", "'c'", "''", "'extra:x'")], lambda f: _fine(builds.setup_cfg(f)))
_parser("parse_setup_py", "from setuptools import setup\nDEPS = ['A{k}>=1.{m}', 'b']\nsetup(name='x', install_requires=DEPS, extras_require={'x': ['c']}, tests_require='t{m}\\nu')\n", ["path", "display_name", "constraint_raw", "group"], [("path", "'A' || k", "'>=1.' || m", "'runtime'"), ("path", "'b'", "''", "'runtime'"), ("path", "'c'", "''", "'extra:x'"), ("path", "'t' || m", "''", "'test'"), ("path", "'u'", "''", "'test'")], lambda f: _fine(builds.setup_py(f)))
_parser("parse_script_metadata", '#!/x\n# /// script\n# dependencies = ["A{k}>=1.{m}", "b"]\n# ///\nimport b\n', ["path", "display_name", "constraint_raw"], [("path", "'A' || k", "'>=1.' || m"), ("path", "'b'", "''")], lambda f: _fine(builds.script_metadata(f)))
_parser("parse_pip_commands", "FROM x\nRUN pip install -U A_{k}==1.{m} 'b>=2' ./local && echo pip\nRUN pip3 install -r req.txt\n", ["path", "line", "package", "constraint_raw"], [("path", "'2'", "'a-' || k", "'==1.' || m"), ("path", "'2'", "'b'", "'>=2'")], builds.pip_commands)
_parser("parse_yarn_lock", '__metadata:\n  version: 8\n\n"a{k}@npm:^1, a{k}@npm:^1.{m}":\n  version: 1.{m}.0\n\n"@s/b@npm:2":\n  version: 2.0.0\n', ["path", "descriptor", "package", "version"], [("path", "'a' || k || '@npm:^1'", "'a' || k", "'1.' || m || '.0'"), ("path", "'a' || k || '@npm:^1.' || m", "'a' || k", "'1.' || m || '.0'"), ("path", "'@s/b@npm:2'", "'@s/b'", "'2.0.0'")], builds.yarn_lock)
_parser("parse_go_imports", 'package x\nimport (\n  "fmt"\n  y "ex.com/y{k}"\n)\nimport "ex.com/z{m}"\n// import "no"\n', ["path", "reference"], [("path", "'fmt'"), ("path", "'ex.com/y' || k"), ("path", "'ex.com/z' || m")], builds.go_imports)
_parser("parse_css_imports", "@import 'a{k}.css';\n/* @import 'no'; */\n@import url(\"b{m}.css\");\n", ["path", "reference"], [("path", "'a' || k || '.css'"), ("path", "'b' || m || '.css'")], builds.css_imports)
_parser("parse_components", "<template><p>import 'no'</p></template>\n<script lang=ts>\nimport a from 'a{k}'\n</script>\n", ["path", "reference"], [("path", "'a' || k")], lambda f: manifests.js_loads(builds.component_scripts(f)))
_parser("parse_rust_references", "use std::io;\nuse serde{m}::X;\n/* use no; */\nextern crate rand{k};\nuse crate::a;\n", ["path", "line", "reference"], [("path", "'2'", "'serde' || m"), ("path", "'4'", "'rand' || k")], builds.rust_references)
_parser("parse_conanfile", "[requires]\nzlib{m}/1.{k}\nfmt/9@u/c\n[tool_requires]\ncmake/3.2\n", ["path", "package", "constraint_raw", "scope"], [("path", "'zlib' || m", "'1.' || k", "'runtime'"), ("path", "'fmt'", "'9'", "'runtime'"), ("path", "'cmake'", "'3.2'", "'build'")], builds.conanfile)
_parser("parse_conan_lock", '{"version":"0.5","requires":["zlib/1.{m}#rev{k}%170","fmt/9@u/c"],"build_requires":["cmake/3.2#r"]}', ["path", "package", "version", "revision", "scope"], [("path", "'zlib'", "'1.' || m", "'rev' || k", "'runtime'"), ("path", "'fmt'", "'9'", "null", "'runtime'"), ("path", "'cmake'", "'3.2'", "'r'", "'build'")], builds.conan_lock)
_parser("parse_cmake", "find_package(Foo{k} 1.{m} REQUIRED)\n# find_package(No)\nFetchContent_Declare(\n  bar\n  GIT_REPOSITORY x\n  GIT_TAG v{m})\nfind_package(${X})\n", ["path", "package", "version", "kind"], [("path", "'Foo' || k", "'1.' || m", "'find_package'"), ("path", "'bar'", "'v' || m", "'fetch_content'")], builds.cmake_commands)
_parser("parse_bazel", 'bazel_dep(name = "a{k}", version = "1.{m}")\n# bazel_dep(name = "no")\nbazel_dep(\n  name = "b",\n  dev_dependency = True)\n', ["path", "package", "version", "dev"], [("path", "'a' || k", "'1.' || m", "false"), ("path", "'b'", "null", "true")], builds.bazel_deps)
_parser("parse_scripts", '{"scripts":{"l":"A=1 npx eslint{m} src","x":"cd a && b","p":"tool{k}"}}', ["path", "script", "executable", "supported"], [("path", "'l'", "'eslint' || m", "true"), ("path", "'x'", "'cd'", "false"), ("path", "'p'", "'tool' || k", "true")], builds.script_commands)
_parser("parse_workflows", "jobs:\n  j{m}:\n    steps:\n    - run: pytest {k}\n    - run: |\n        a\n        b c\n    - uses: x\n", ["path", "job", "command"], [("path", "'j' || m", "'pytest ' || k"), ("path", "'j' || m", "'a'"), ("path", "'j' || m", "'b c'")], lambda f: _fine(builds.workflow_commands(f)))
_parser("parse_tsconfig", '{"compilerOptions":{"types":["node{m}","@s/t{k}/x","./local"]}}', ["path", "package"], [("path", "'@types/node' || m"), ("path", "'@s/t' || k")], builds.tsconfig_types)
_parser("parse_python_tasks", '[tool.hatch.envs.e{m}.scripts]\nrun = ["a {k}", "b"]\n[tool.poe.tasks]\nt = "pytest {m}"\ns = {cmd = "x"}\nq = ["one", {shell = "two"}]\n', ["path", "tool", "task", "command"], [("path", "'hatch'", "'e' || m || ':run'", "'a ' || k"), ("path", "'hatch'", "'e' || m || ':run'", "'b'"), ("path", "'poe'", "'t'", "'pytest ' || m"), ("path", "'poe'", "'s'", "'x'"), ("path", "'poe'", "'q'", "'one'"), ("path", "'poe'", "'q'", "'two'")], lambda f: _fine(builds.python_tasks(f)))
_parser(
    "uv_origins", '[[tool.uv.index]]\nname = "corp"\nurl = "https://corp/{m}"\nexplicit = true\n[[tool.uv.index]]\nname = "d"\nurl = "https://def/{k}"\ndefault = true\n[tool.uv.sources]\nA_x = {index = "corp"}\ng = {git = "https://g/{k}"}\n', ["path", "package", "origin"],
    [("path", "'a-x'", "'https://corp/' || m"), ("path", "'g'", "'https://g/' || k"), ("path", "'plain'", "'https://def/' || k")], lambda f: builds.uv_origins(f.select("path", F.explode(F.array(*map(F.lit, ["a-x", "g", "plain"]))).alias("package")), _fine(builds.uv_sources(f))),
)
_parser("parse_pytest_plugins", "[pytest]\naddopts = -q -p plug{m} -p no:cacheprovider\nrequired_plugins = pytest-x{k}>=1\n", ["path", "module"], [("path", "'plug' || m"), ("path", "'pytest-x' || k")], lambda f: _fine(builds.pytest_plugins(f)))
_parser("python_fan_in", '[project]\ndependencies = ["A{k}", "A{k}", "b"]\n', ["manifest", "path", "package", "occurrence"], [("'pyproject'", "path", "'a' || k", "'1'"), ("'pyproject'", "path", "'a' || k", "'2'"), ("'pyproject'", "path", "'b'", "'1'"), ("'requirements'", "path", "'r' || m", "'1'")], lambda f: builds.fan_in({"pyproject": _fine(manifests.pyproject(f)), "requirements": manifests.requirements(f.select("path", F.concat(F.lit("r"), (F.regexp_extract("path", r"(\d+)", 1).cast("long") % 7).cast("string")).alias("text")))}))
_parser("read_configuration", 'exclude = ["gen{k}", "out"]\n[import-mapping]\nyaml = "pyyaml{m}"\n', ["path", "key", "name", "value"], [("path", "'exclude'", "null", "'gen' || k"), ("path", "'exclude'", "null", "'out'"), ("path", "'import-mapping'", "'yaml'", "'pyyaml' || m")], lambda f: _fine(settings.configuration(f)))
_parser("read_policy", '{"fail_on":["r{m}"],"exemptions":[{"risk":"r","package":"p{k}","owner":"o","reason":"x","expires_at":"2030-01-0{m}"},{"risk":"r","package":"q","owner":" ","reason":"x","expires_at":"2030-01-01"}]}', ["path", "place", "package", "problem"], [("path", "'0'", "'p' || k", "case when m = 0 then 'policy.incomplete' end"), ("path", "'1'", "'q'", "'policy.incomplete'")], lambda f: settings.policy(f)[1])
_parser("read_records", '{"records":[{"package":"p{k}","version":"1.{m}","scripts":"s"},{"package":"q"}]}', ["path", "place", "package", "version", "problem"], [("path", "'0'", "'p' || k", "'1.' || m", "null"), ("path", "'1'", "'q'", "null", "'record.incomplete'")], lambda f: settings.records(f, "behavior"))


@_query("""with p as (select p_partkey k, p_partkey % 5 f from part), v(k, key, value, status) as (
select k, 'a', cast(k as varchar), 'resolved' from p union all select k, 'b', 'x' || k || '-' || k, 'resolved' from p where f = 0 union all select k, 'b', '${gone}/' || k, 'unresolved' from p where f = 1
union all select k, 'b', '${c}', 'cycle' from p where f = 2 union all select k, 'c', '${b}' || '${a}', 'cycle' from p where f = 2 union all select k, 'd', '${b}+', 'cycle' from p where f = 2
union all select k, 'b', 'v' || k || '.v' || k || '!', 'resolved' from p where f = 3 union all select k, 'c', 'v' || k, 'resolved' from p where f = 3 union all select k, 'b', '$ ' || '${}', 'unresolved' from p where f = 4)
select 'd/p' || k || '/pom.xml' path, key, value, status from v""")
def pom_properties(spark, sf_dir):
    """Five forms of properties by a part's key: embedded, unknown, in and behind a cycle, nested through two levels, and odd texts."""
    k = F.col("p_partkey")
    s, f = k.cast("string"), k % 5
    tags = (
        F.when(f == 0, "<b>x${a}-${a}</b>").when(f == 1, "<b>${gone}/${a}</b>").when(f == 2, "<b>${c}</b><c>${b}${a}</c><d>${b}+</d>").when(f == 3, "<b>${c}.${c}!</b><c>v${a}</c>").otherwise("<b>$ ${}</b>")
    )
    text = F.concat(F.lit("<project><groupId>g</groupId><artifactId>p"), s, F.lit("</artifactId><properties><a>"), s, F.lit("</a>"), tags, F.lit("</properties></project>"))
    files = spread(_t(spark, sf_dir, "part").select("p_partkey")).select(F.concat(F.lit("d/p"), s, F.lit("/pom.xml")).alias("path"), text.alias("text"))
    return manifests.pom_properties(files).where("length(key) = 1")
