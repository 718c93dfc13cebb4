"""Sources of JavaScript, Gradle and CMake in eleven forms each, chosen by the part's key; the SQL says which rows each form gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.lineage import spread
from lodestrata.sources import builds, manifests

from .driver_queries import ORACLE, QUERIES, _t


def _forms(name: str, columns: list[str], forms: list[tuple[str, str, list[tuple]]], read: Callable[[DataFrame], DataFrame]) -> None:
    """Registers ``read`` over a file for each part: ``forms`` are (ending, text, rows), rows SQL expressions over ``k`` (the key) and ``m`` (its rest of 7)."""

    def run(spark, sf_dir):
        key = F.col("p_partkey")
        pick = lambda i: F.element_at(F.array(*[F.lit(f[i]) for f in forms]), (key % len(forms) + 1).cast("int"))
        text = F.replace(F.replace(pick(1), F.lit("{k}"), key.cast("string")), F.lit("{m}"), (key % 7).cast("string"))
        out = read(spread(_t(spark, sf_dir, "part").select("p_partkey")).select(F.concat(F.lit("f"), key.cast("string"), pick(0)).alias("path"), text.alias("text")))
        return out.select("path", *[F.col(c).cast("string") if c == "line" else F.col(c) for c in columns])

    run.__name__ = name
    QUERIES[name] = run
    parts = [
        f"select 'f' || k || '{ending}' as path, " + ", ".join(f'{e} as "{c}"' for c, e in zip(columns, row, strict=True)) + f" from p where k % {len(forms)} = {i}"
        for i, (ending, _, rows) in enumerate(forms) for row in rows
    ]
    ORACLE[name] = "with p as (select p_partkey k, p_partkey % 7 m from part) " + " union all ".join(parts)


_REG, _DYN = "'regular'", "'dynamic'"
_forms(
    "js_load_forms", ["line", "reference", "kind"],
    [
        (".js", "const r = /[`]/; import 'x{k}';\nconst t = `import 'no'`;\n", [("'1'", "'x' || k", _REG)]),
        (".js", "obj.require('no');\nconst p = require.resolve('r{m}');\na?.import('no');\nrequire('@s/y{k}')\n", [("'2'", "'r' || m", "'resolve'"), ("'4'", "'@s/y' || k", _REG)]),
        (".jsx", "const x = <div title=\"it's\">\n don't import 'no' {require('in{k}')}\n <B a={`${import('deep{m}')}`}/>\n <></>\n</div>;\nimport 'after'\n", [("'2'", "'in' || k", _REG), ("'3'", "'deep' || m", _DYN), ("'6'", "'after'", _REG)]),
        (".mjs", "#!/usr/bin/env node import 'no'\nq = b / c; d = e / f; import 'x{k}';\nif (x) /['\"]/.test(y);\nexport { a, b as c } from 'm{m}'\n", [("'2'", "'x' || k", _REG), ("'4'", "'m' || m", _REG)]),
        (".ts", "function f<T>(x: Array<T>) { return <T>x; }\nimport type { T } from 't{k}';\nimport x = require('eq{m}');\n", [("'2'", "'t' || k", _REG), ("'3'", "'eq' || m", _REG)]),
        (".tsx", "const g = <T extends U>(x: T) => x;\r\nexport * as n from 'n{k}'\r\nconst h = <T,>(x: T) => <p>from 'no'</p>;\r\nimport a, { b } from 'b{m}' with { type: 'json' }\r\n", [("'2'", "'n' || k", _REG), ("'4'", "'b' || m", _REG)]),
        (".ts", "`a ${ {x: `}`, y: require('in{k}')} } import 'no'`;\nimport(name);\nimport('d{m}', { with: {} });\n", [("'1'", "'in' || k", _REG), ("'3'", "'d' || m", _DYN)]),
        (".js", "/* import 'no'\n // */ import from from 'w{k}';\n// require('no')\ns = 'import \\'no\\''; x++ / 2; import 'e{m}' /* / */\n", [("'2'", "'w' || k", _REG), ("'4'", "'e' || m", _REG)]),
        (".cjs", "exports.a = require\n(\n 'o{k}'\n);\nrequire('a' + 'b');\nconst { x } = require('s{m}'), y = { require: 'no' };\n", [("'1'", "'o' || k", _REG), ("'6'", "'s' || m", _REG)]),
        (".ts", "export const c = {a: 1} / 2; import {\n  one,\n  two as three,\n} from\n 'l{k}'\nexport default foo\nimport z from 'z{m}'\n", [("'1'", "'l' || k", _REG), ("'7'", "'z' || m", _REG)]),
        (".js", "}) import 'kept{k}'\nconst s = 'never closed\nrequire('also{m}'\nimport { 'no\n", [("'1'", "'kept' || k", _REG)]),
    ],
    manifests.js_loads,
)


def _g(line: str, package: str, version: str, configuration: str, scope: str, kind: str = "dependency", literal: str = "true", context: str = "dependencies") -> tuple:
    return f"'{line}'", package, version, f"'{configuration}'", f"'{scope}'", f"'{kind}'", literal, f"'{context}'"


_forms(
    "gradle_forms", ["line", "package", "constraint_raw", "configuration", "scope", "kind", "literal", "context"],
    [
        (".gradle", "dependencies {\n  implementation 'g:a{k}:1.{m}', \"g:b:$v\"\n}\n", [_g("2", "'g:a' || k", "'1.' || m", "implementation", "runtime"), _g("2", "'g:b'", "'$v'", "implementation", "runtime", literal="false")]),
        (".gradle", "buildscript { dependencies { classpath 'a:p{k}:{m}' } }\n", [_g("1", "'a:p' || k", "m::varchar", "classpath", "build", context="buildscript/dependencies")]),
        (".kts", "dependencies {\n  implementation(platform(\"g:bom{k}:2\"))\n  api(enforcedPlatform(\"g:e:{m}\"))\n}\n", [_g("2", "'g:bom' || k", "'2'", "implementation", "build", "platform"), _g("3", "'g:e'", "m::varchar", "api", "build", "enforcedPlatform")]),
        (".gradle", "dependencies {\n api group: 'g', name: 'n{k}', version: '{m}'\n compileOnly group: 'g', name: 'o'\n}\n", [_g("2", "'g:n' || k", "m::varchar", "api", "runtime"), _g("3", "'g:o'", "null", "compileOnly", "optional")]),
        (".gradle", "dependencies { // api 'no:no:1'\n /* api 'no:no:2'\n */ testImplementation(\"g:t{k}:1.{m}:cls@jar\") { exclude group: 'x', module: 'y' }\n}\n", [_g("3", "'g:t' || k", "'1.' || m", "testImplementation", "test")]),
        (".kts", "dependencies {\n constraints {\n  api(\"g:k{k}:{m}\")\n }\n runtimeOnly(\"g:r\")\n}\n", [_g("3", "'g:k' || k", "m::varchar", "api", "build", "constraint", context="dependencies/constraints"), _g("5", "'g:r'", "null", "runtimeOnly", "runtime")]),
        (".gradle", "dependencies {\n add(\"custom\", \"g:z{k}:1\")\n mine 'g:u{m}'\n implementation project(':x')\n implementation libs.foo\n api \"g:$x:1\"\n}\n", [_g("2", "'g:z' || k", "'1'", "custom", "unknown"), _g("3", "'g:u' || m", "null", "mine", "unknown")]),
        (".gradle", "println \"implementation 'no:no:1'\"\ntask x { doLast { implementation 'no:no:2' } }\nsubprojects {\n dependencies { kapt 'g:s{k}:{m}' }\n}\n", [_g("4", "'g:s' || k", "m::varchar", "kapt", "build", context="subprojects/dependencies")]),
        (".kts", "kotlin {\r\n sourceSets.named(\"main\") {\r\n  dependencies {\r\n   implementation(\r\n    \"g:d{k}:[1,{m})\")\r\n  }\r\n }\r\n}\r\n", [_g("4", "'g:d' || k", "'[1,' || m || ')'", "implementation", "runtime", context="kotlin/named/dependencies")]),
        (".gradle", "def t = '''\ndependencies { api 'no:no:1' }\n'''\ndependencies { api 'g:q{k}:1'; implementation 'g:w:{m}' }\n", [_g("4", "'g:q' || k", "'1'", "api", "runtime"), _g("4", "'g:w'", "m::varchar", "implementation", "runtime")]),
        (".gradle", "dependencies {\n api 'g:kept{k}:{m}'\n api 'g:open:1\n", [_g("2", "'g:kept' || k", "m::varchar", "api", "runtime")]),
    ],
    builds.gradle_dependencies,
)


def _c(line: str, package: str, version: str = "null", kind: str = "find_package", required: str = "false", components: str = "null", conditional: str = "false") -> tuple:
    return f"'{line}'", package, version, f"'{kind}'", required, components, conditional


_forms(
    "cmake_forms", ["line", "package", "version", "kind", "required", "components", "conditional"],
    [
        (".cmake", "find_package(Foo{k} 1.{m} REQUIRED)\n# find_package(No)\n", [_c("1", "'Foo' || k", "'1.' || m", required="true")]),
        (".cmake", "#[[ find_package(No)\n]] FIND_PACKAGE( Foo{k} 1.{m}...<9 EXACT\n  COMPONENTS a b{m} )\n", [_c("2", "'Foo' || k", "'1.' || m || '...<9'", components="'a,b' || m")]),
        (".cmake", "if(X AND (Y OR Z))\n  find_package(In{k})\nelse()\n  find_package(${V})\nendif()\nfind_package(Out{m})\n", [_c("2", "'In' || k", conditional="true"), _c("6", "'Out' || m")]),
        (".cmake", "set(t \"find_package(No)\")\nset(u [=[ find_package(No) ]] ]=])\nfind_package(Foo{k} CONFIG)\n", [_c("3", "'Foo' || k")]),
        (".cmake", "FetchContent_Declare(\n  bar{k}\n  GIT_REPOSITORY \"https://x/#y\"\n  GIT_TAG v{m})\n", [_c("1", "'bar' || k", "'v' || m", "fetch_content", "true")]),
        (".cmake", "function(f)\n  find_package(A{k} REQUIRED c d NO_MODULE)\nendfunction()\nforeach(x a b)\n find_package(B{m} 2)\nendforeach()\n", [_c("2", "'A' || k", required="true", components="'c,d'", conditional="true"), _c("5", "'B' || m", "'2'", conditional="true")]),
        (".cmake", "find_dependency(Z{k} 2.{m}) find_package(Y)\r\nfind_package(W{m})\r\n", [_c("1", "'Z' || k", "'2.' || m", "find_dependency"), _c("1", "'Y'"), _c("2", "'W' || m")]),
        (".cmake", "FetchContent_Declare(q{k} URL https://h/q-{m}.zip)\nFetchContent_Declare(w GIT_TAG ${TAG})\n", [_c("1", "'q' || k", kind="fetch_content", required="true"), _c("2", "'w'", kind="fetch_content", required="true")]),
        (".cmake", "find_package(\"Quoted{k}\" \"3.{m}\" QUIET)\nfind_package(esc\\;aped)\n", [_c("1", "'Quoted' || k", "'3.' || m")]),
        (".cmake", "message(\"a \\\" find_package(No)\") find_package(M{k} # why (\n  {m}.0)\n", [_c("1", "'M' || k", "m || '.0'")]),
        (".cmake", "endif()\nfind_package(Kept{k} {m})\nfind_package(Open\n", [_c("2", "'Kept' || k", "m::varchar")]),
    ],
    builds.cmake_commands,
)
