"""Whole scans, call graphs, positions and documents on generated files and the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.lineage import cut, spread
from lodestrata.operators import compare, inventory
from lodestrata.plans import incremental, reports, scan, store
from lodestrata.sources import manifests, positions

from .driver_queries import _query, _t
from .parser_queries import _fine, _parser

#: Files of a project with an npm and a Python side; ``{k}`` is a part's key, ``{m}`` its rest of 7. Every seventh has an unreadable source.
_PROJECT = {
    "package.json": '{"dependencies":{"a{m}":"^1","used":"1.0.0"}}',
    "src/i.js": "import 'used'\nimport {\n x } from 'missing{m}/x'\n",
    "package-lock.json": '{"lockfileVersion":3,"packages":{"":{},"node_modules/used":{"version":"1.0.0"}}}',
    "pyproject.toml": '[project]\ndependencies = ["req{m}==1.0", "idle>=2"]\n',
    "pkg/m.py": "import os, req{m}\nimport gone\nimport yaml.nodes\nfrom pkg import n\n",
}


def _files(spark, sf_dir):
    key, rest = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 7).cast("string")
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{k}"), key), F.lit("{m}"), rest)
    entries = F.array(*[F.struct(F.concat(F.lit("p"), key, F.lit(f"/{name}")).alias("path"), (F.when(F.col("p_partkey") % 7 == 5, "def") if name.endswith(".py") else F.when(F.lit(False), "")).otherwise(fill(text)).alias("text")) for name, text in _PROJECT.items()])
    return spread(_t(spark, sf_dir, "part").select("p_partkey")).select(F.explode(entries).alias("f")).select("f.*")


_FOUND = """with p as (select 'p' || p_partkey id, p_partkey % 7 m from part), f as (
select id project_id, 'npm' ecosystem, 'missing' || m package, 'dependency.missing' code, 'error' severity from p union all select id, 'npm', 'a' || m, 'dependency.unpinned', 'warning' from p
union all select id, 'npm', 'a' || m, 'dependency.unused', 'warning' from p where m <> 5 union all select id, 'pypi', 'idle', 'dependency.unpinned', 'warning' from p
union all select id, 'pypi', 'idle', 'dependency.unused', 'warning' from p where m <> 5 union all select id, 'pypi', 'pyyaml', 'dependency.missing', 'error' from p where m <> 5)"""


#: Ten projects by a part's key: files of each, and the findings that they must give (ecosystem, package, code without its prefix, severity).
_LAYOUTS = [
    ({"package.json": '{"dependencies":{"x{m}":"1.0.0"}}', "a.js": "import fs from 'fs'\nimport p from 'node:path'\nimport y from 'x{m}/lib'\nimport './b'\nimport 'fs/promises'\n", "b.js": "require('https')"}, []),
    ({"pyproject.toml": '[project]\ndependencies = ["PyYAML==6.0", "Pillow==1.0"]\n', "pkg/a.py": "import os, sys, yaml\nfrom pkg import b\nfrom PIL import Image\nimport pkg.b.c\n", "pkg/b.py": "import json.decoder\n", "tool.py": "import pkg\n"}, []),
    ({"requirements.txt": "requests==2.0\nidle{m}==1\n", "src/app/m.py": "import app.x\nimport requests\nimport tool{m}\n", "setup.py": "import setuptools_{m}\n"}, [("pypi", "idle{m}", "unused", "warning")]),
    ({"package.json": '{"devDependencies":{"jest":"29.0.0","chai":"4.0.0"},"scripts":{"test":"jest --ci"}}', "src/i.test.js": "import 'chai'\n", "src/i.js": "import 'chai'\n"}, [("npm", "chai", "scope-mismatch", "error")]),
    ({"pyproject.toml": '[project]\ndependencies = []\n[dependency-groups]\ndev = ["pytest==8.0", "bs4-x{m}==1"]\n', "tests/test_a.py": "import pytest\nimport yaml\n", "conftest.py": "import pytest\n"}, [("pypi", "pyyaml", "missing", "error"), ("pypi", "bs4-x{m}", "unused", "warning")]),
    ({"go.mod": "module ex.com/own{m}\n\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgithub.com/a/b/v2 v2.0.0\n\tgolang.org/x/t v0.1.0 // indirect\n\tgithub.com/c/idle v1.0.0\n)\n", "m.go": 'package m\nimport (\n\t"fmt"\n\t"net/http"\n\t"ex.com/own{m}/sub"\n\t"github.com/a/b/v2/x"\n\t"github.com/a/b/y"\n)\n'}, [("go", "github.com/c/idle", "unused", "warning")]),
    ({"Cargo.toml": '[package]\nname = "own"\n[dependencies]\nserde-x{m} = "=1.0.0"\nidle = "=1.0.0"\n[dev-dependencies]\nrstest = "=0.1.0"\n', "src/main.rs": "mod util;\nuse std::fs;\nuse serde_x{m}::De;\nuse util::x;\nuse crate::util;\n", "src/util.rs": "use super::x;\n", "tests/t.rs": "use rstest::rstest;\n"}, [("cargo", "idle", "unused", "warning")]),
    ({"package.json": '{"dependencies":{"@s/a":"^1.0.0","v{m}":"1.0.0-rc.1"}}', "vite.config.js": "import '@s/a/plugin'\nimport 'lost-{m}'\n", "i.ts": "import v from 'v{m}'\n// import 'no'\nconst t = `import 'no2'`\n"}, [("npm", "@s/a", "unpinned", "warning"), ("npm", "lost-{m}", "missing", "error")]),
    ({"package.json": '{"dependencies":{"outer":"1.0.0"}}', "o.js": "import 'outer'", "in/package.json": '{"dependencies":{"inner":"1.0.0"}}', "in/i.js": "import 'inner'\nimport 'outer'"}, [("npm", "outer", "missing", "error")]),
    ({"pyproject.toml": "[project\n", "a.py": "import yaml\n"}, []),
]


def _layouts(spark, sf_dir):
    key, rest = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 7).cast("string")
    fill = lambda t: F.replace(F.lit(t), F.lit("{m}"), rest)
    pick = None
    for i, (files, _) in enumerate(_LAYOUTS):
        entries = F.array(*[F.struct(F.concat(F.lit("q"), key, F.lit(f"/{n}")).alias("path"), fill(t).alias("text")) for n, t in files.items()])
        pick = F.when(F.col("p_partkey") % 10 == i, entries) if pick is None else pick.when(F.col("p_partkey") % 10 == i, entries)
    return spread(_t(spark, sf_dir, "part").select("p_partkey")).select(F.explode(pick).alias("f")).select("f.*")


_LAYOUT_ROWS = " union all ".join(
    f"select 'q' || p_partkey || '{'/in' if i == 8 else ''}' project_id, '{eco}' ecosystem, replace('{package}', '{{m}}', cast(p_partkey % 7 as varchar)) package, 'dependency.{code}' code, '{severity}' severity from part where p_partkey % 10 = {i}"
    for i, (_, found) in enumerate(_LAYOUTS) for eco, package, code, severity in found
)


@_query(_LAYOUT_ROWS)
def scan_layouts(spark, sf_dir):
    """Ten layouts with standard, built-in and own modules, tests, tools, nested projects and an unreadable manifest: only true findings."""
    return scan.scan(_layouts(spark, sf_dir))["findings"]


@_query(f"{_FOUND} select * from f")
def scan_findings(spark, sf_dir):
    return scan.scan(_files(spark, sf_dir))["findings"]


@_query(f"""{_FOUND} select 'findings' relation, cast(to_json({{'code': code, 'ecosystem': ecosystem, 'package': package, 'project_id': project_id, 'severity': severity}}) as varchar) as row from f
union all select 'diagnostics', cast(to_json({{'code': 'usage.unreadable', 'path': id || '/pkg/m.py', 'project_id': id, 'severity': 'error'}}) as varchar) from p where m = 5
union all select 'projects', cast(to_json({{'ecosystem': e, 'project_id': id}}) as varchar) from p, (values ('npm'), ('pypi')) t(e)
union all select 'capabilities', cast(to_json({{'name': n, 'project_id': id, 'state': case when n = 'usage' and m = 5 then 'partial' else 'complete' end}}) as varchar) from p, (values ('manifest'), ('usage')) t(n)""")
def scan_document(spark, sf_dir):
    whole = scan.scan(_files(spark, sf_dir))
    return scan.canonical_rows({n: whole[n].drop("message") for n in ("findings", "diagnostics", "projects", "capabilities")})


@_query("select 'findings.no-evidence' as \"check\", 3 * count(*) n from part where p_partkey % 7 = 1 union all select 'usages.no-package', count(*) from part where p_partkey % 7 = 2 union all select 'declarations.unknown-project', 4 * count(*) from part where p_partkey % 7 = 3")
def export_problems(spark, sf_dir):
    """A scan with faults put in: findings without evidence, usages without a package, declarations of projects that aren't listed."""
    whole = scan.scan(_files(spark, sf_dir))
    number = F.regexp_extract("project_id", r"(\d+)", 1).cast("long") % 7
    lone = whole["projects"].where((number == 1) & (F.col("ecosystem") == "npm")).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("project_id", "ecosystem", F.concat(F.lit("ghost"), F.col("n").cast("string")).alias("package"), F.lit("x").alias("code"), F.lit("error").alias("severity"))
    blank = whole["usages"].where((number == 2) & (F.col("package") == "used")).withColumn("package", F.lit(""))
    parts = {**whole, "findings": whole["findings"].unionByName(lone), "usages": whole["usages"].unionByName(blank)}
    moved = F.when(number == 3, F.concat(F.lit("lost/"), "project_id")).otherwise(F.col("project_id"))
    parts["declarations"] = whole["declarations"].withColumn("project_id", moved)
    parts["findings"] = parts["findings"].where((number != 3) | F.col("code").isin("dependency.missing"))
    return scan.export_problems(parts)


@_query("""with recursive n as (select c_custkey k from customer), m as (select max(k) top from n),
e as (select k a, k // 2 b, false c from n where k > 1 union all select k, k - 1, true from n where k % 10 = 3 union all select k, 2 * k, false from n where k % 100 = 0 union all select k, -k, false from n where k % 50 = 7),
cl(r, p, c, d) as (select k, k, false, 0 from n where k % 20 = 9 union select r, b, cl.c or e.c, d + 1 from cl join e on e.a = cl.p where d < 40 and cl.p > 0),
ok as (select e.a, e.b from e join n on n.k = e.b), up(a, b) as (select a, b from ok union select up.a, ok.b from up join ok on ok.a = up.b), turning as (select distinct a from up where a in (select a from up where a = b) union select distinct a from up where b in (select a from up where a = b))
select 'r/f' || r || '.txt' root, case when p < 0 then 'r/gone' || -p || '.txt' else 'r/f' || p || '.txt' end path, case when c then 'constraint' else 'requirement' end kind, min(d) depth, case when p between 1 and (select top from m) then 'found' else 'missing' end status,
p in (select a from turning) endless from cl group by r, p, c""")
def include_closure(spark, sf_dir):
    """Customers as requirements files: each includes its half, some constrain their neighbour, some go round with their double, some name what isn't there."""
    k = F.col("c_custkey")
    line = lambda when, text: F.when(when, text).otherwise("")
    name = lambda x: F.concat(F.lit("f"), x.cast("string"), F.lit(".txt\n"))
    text = F.concat(line(k > 1, F.concat(F.lit("-r "), name(F.floor(k / 2)))), F.lit("pkg==1\n"), line(k % 10 == 3, F.concat(F.lit("-c "), name(k - 1))), line(k % 100 == 0, F.concat(F.lit("--requirement=../r/"), name(2 * k))), line(k % 50 == 7, F.concat(F.lit("-r gone"), k.cast("string"), F.lit(".txt"))))
    files = _t(spark, sf_dir, "customer").select(F.concat(F.lit("r/f"), k.cast("string"), F.lit(".txt")).alias("path"), text.alias("text"), k.alias("k"))
    return manifests.include_closure(files, files.where("k % 20 = 9"))


@_query(_LAYOUT_ROWS.replace("p_partkey % 10 =", "p_partkey % 7 <> 3 and p_partkey % 10 =") + " union all " + _LAYOUT_ROWS.replace("'q' ||", "'n/q' ||").replace("p_partkey % 10 =", "p_partkey % 7 = 3 and p_partkey % 10 ="))
def scan_update(spark, sf_dir):
    """A scan brought up to date after every seventh project moved and one project in eleven had been broken before: the findings of a new scan."""
    files = _layouts(spark, sf_dir)
    k = F.regexp_extract("path", r"^q(\d+)", 1).cast("long")
    broken = files.withColumn("text", F.when((k % 11 == 0) & F.col("path").rlike("(json|toml|txt|mod)$"), "{}").otherwise(F.col("text")))
    moved = files.withColumn("path", F.when(k % 7 == 3, F.concat(F.lit("n/"), "path")).otherwise(F.col("path")))
    return incremental.update(scan.scan(broken), incremental.file_state(broken), moved)[0]["findings"]


_CALLS = "import lib\nfrom other{m} import helper\ndef a{k}():\n    b()\n    helper()\n    lib.go{m}()\ndef b():\n    return len('x')\nclass C:\n    def run(self):\n        self.go()\n    def go(self):\n        a{k}()\n"
_parser(
    "python_calls", _CALLS, ["path", "caller", "callee"],
    [("path", "'d.f' || k || '.a' || k", "'d.f' || k || '.b'"), ("path", "'d.f' || k || '.a' || k", "'other' || m || '.helper'"), ("path", "'d.f' || k || '.a' || k", "'lib.go' || m"), ("path", "'d.f' || k || '.C.run'", "'d.f' || k || '.C.go'"), ("path", "'d.f' || k || '.C.go'", "'d.f' || k || '.a' || k")],
    lambda f: _fine(scan.python_calls(f)), "d/f{k}.py",
)
_parser(
    "callable_symbols", _CALLS, ["node", "entry"],
    [("'d.f' || k || '.C.run'", "'d.f' || k || '.C.run'"), ("'d.f' || k || '.C.go'", "'d.f' || k || '.C.run'"), ("'d.f' || k || '.a' || k", "'d.f' || k || '.C.run'"), ("'d.f' || k || '.b'", "'d.f' || k || '.C.run'"), ("'other' || m || '.helper'", "'d.f' || k || '.C.run'"), ("'lib.go' || m", "'d.f' || k || '.C.run'")],
    lambda f: scan.callable_from(calls := cut(_fine(scan.python_calls(f))), calls.where(F.col("caller").endswith(".run")).select(F.col("caller").alias("entry")))[0].withColumnRenamed("fact", "entry"), "d/f{k}.py",
)
_parser("json_positions", '{"a{k}": [1, {"b": "x: {m}"}],\n  "c" : {"d{m}": null}}', ["path", "line", "column", "key"], [("path", "'1'", "'2'", "'.a' || k"), ("path", "'1'", "cast(12 + length(cast(k as varchar)) as varchar)", "'.a' || k || '[1].b'"), ("path", "'2'", "'3'", "'.c'"), ("path", "'2'", "'10'", "'.c.d' || m")], lambda f: _fine(positions.json_keys(f)))
_parser("ini_positions", "# x\n[options]\nInstall_Requires =\n  a{k}\n[s{m}]\nb: 1\n", ["path", "line", "section", "key"], [("path", "'2'", "'options'", "null"), ("path", "'3'", "'options'", "'install_requires'"), ("path", "'5'", "'s' || m", "null"), ("path", "'6'", "'s' || m", "'b'")], lambda f: _fine(positions.ini_keys(f)))


@_query("select n_nationkey, case when n_nationkey in (select s_nationkey from supplier) then (select max(s_name) from supplier where s_nationkey = n_nationkey) else n_name end as value from nation")
def metadata_upsert(spark, sf_dir):
    table = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value"))
    rows = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_name").alias("value"))
    return store.upsert(table, rows, "n_nationkey")


@_query("""with f as (select case c_custkey % 3 when 0 then 'dependency.missing' when 1 then 'dependency.unused' else 'vulnerability.found' end code, c_nationkey project_id, c_mktsegment package from customer)
select code, package, count(*) n from f where code like 'dependency.%' and package = 'BUILDING' group by all""")
def findings_by_package(spark, sf_dir):
    k = F.col("c_custkey")
    rows = _t(spark, sf_dir, "customer").select(F.when(k % 3 == 0, "dependency.missing").when(k % 3 == 1, "dependency.unused").otherwise("vulnerability.found").alias("code"), F.lit("npm").alias("ecosystem"), F.col("c_nationkey").alias("project_id"), F.col("c_mktsegment").alias("package"))
    return inventory.filtered(rows, package="BUILDING").where(F.col("code").startswith("dependency.")).groupBy("code", "package").agg(F.count("*").alias("n"))


@_query("""with c as (select c_nationkey project_id, case c_custkey % 3 when 0 then 'manifest' when 1 then 'usage' else 'mapping' end as name, case when c_custkey % 11 = 0 then 0 when c_custkey % 7 = 0 then 1 else 2 end k from customer),
w as (select project_id, name, case min(k) when 0 then 'unsupported' when 1 then 'partial' else 'complete' end state from c group by all) select project_id, string_agg(name || '=' || state, ',' order by name) capabilities from w group by 1""")
def capability_maps(spark, sf_dir):
    k = F.col("c_custkey")
    rows = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project_id"), F.when(k % 3 == 0, "manifest").when(k % 3 == 1, "usage").otherwise("mapping").alias("name"), F.when(k % 11 == 0, "unsupported").when(k % 7 == 0, "partial").otherwise("complete").alias("state"))
    return inventory.capability_maps(rows).select("project_id", F.array_join(F.transform(F.map_entries("capabilities"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("capabilities"))


@_query("""select coalesce(c_custkey, o) id, case when c_custkey is null then 'no-old-snapshot' when o is null then 'no-new-snapshot' when c_nationkey % 3 <> o % 3 then 'other-repository' when c_nationkey % 2 <> o % 2 then 'other-selection' when c_mktsegment <> 'BUILDING' then 'other-revision' end reason
from customer full join (select distinct o_custkey + 20 o from orders) on o = c_custkey""")
def comparable_snapshots(spark, sf_dir):
    old = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("revision"), (F.col("c_nationkey") % 3).cast("long").alias("repository_key"), (F.col("c_nationkey") % 2).cast("long").alias("selection_key"))
    o = F.col("o_custkey") + 20
    new = _t(spark, sf_dir, "orders").select(o.alias("id"), F.lit("BUILDING").alias("revision"), (o % 3).alias("repository_key"), (o % 2).alias("selection_key")).distinct()
    return compare.comparable(old, new)


@_query("""select case when o_totalprice > 100000 then 'ERROR' else 'WARNING' end || ' c' || o_orderstatus || ' p' || o_custkey || ': bad?[31m ' || o_orderkey || case when o_orderkey % 3 = 0 then ' (d/f' || o_orderkey % 7 || case when o_orderkey % 2 = 0 then ':' || o_orderkey % 9 else '' end || ')' else '' end line from orders""")
def text_report(spark, sf_dir):
    o = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    rows = _t(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), "o_orderstatus").alias("code"), F.when(F.col("o_totalprice") > 100000, "error").otherwise("warning").alias("severity"), F.concat(F.lit("p"), s(F.col("o_custkey"))).alias("package"), F.concat(F.lit("bad\x1b[31m "), s(o)).alias("message"),
        F.when(o % 3 == 0, F.concat(F.lit("d/f"), s(o % 7))).alias("path"), F.when(o % 2 == 0, o % 9).alias("line"),
    )
    return reports.text_lines(rows)
